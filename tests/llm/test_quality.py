import numpy as np
from pyspark.sql import functions as F

from millrace.llm.language import fold
from millrace.llm import quality
from millrace.llm.quality import FEATURES, accepted, features, fit, scored, trained


def corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 200))]
        good = rng.random() < 0.7
        if not good:
            words = rng.choice([[words[0]] * len(words), [w.upper() + "!!" for w in words], [w + "###" for w in words]])
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(frame, rng):
    rows, labels = corpus(rng, 600)
    documents, marks = frame(rows, "doc_id bigint, text string"), frame(labels, "doc_id bigint, quality int")
    model = trained(documents, marks.filter(fold(F.col("doc_id"), 3) != 1))
    held = documents.filter(fold(F.col("doc_id"), 3) == 1)
    got = {r.id: r.score for r in scored(held, model).collect()}
    want = dict(labels)
    assert np.mean([(s >= 0.5) == want[i] for i, s in got.items()]) > 0.97
    kept = {r.doc_id for r in accepted(documents, model).collect()}
    all_scores = {r.id: r.score for r in scored(documents, model).collect()}
    assert kept == {i for i, s in all_scores.items() if s >= 0.5}


def test_pairs_learn_what_single_tables_cannot():
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(4000, len(FEATURES))).astype(np.float32)
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = fit(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95
    assert (2, 7) in [(i, j) for i, j, _ in model.pairs]


def slow_fit(x, y):
    """The single tables by the definition: trees of four leaves on the slopes, bin by bin, row by row."""
    n, width = x.shape
    start = np.log((y.sum() + 1) / (n - y.sum() + 1))
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, quality.BINS + 1)[1:-1])).astype(np.float32) for i in range(width)]
    bins = [[sum(e <= v for e in edges[i]) for v in x[:, i]] for i in range(width)]
    tables = [[0.0] * (len(e) + 1) for e in edges]

    def total(r):
        return start + sum(tables[i][bins[i][r]] for i in range(width))

    def gain(rows, g, h):
        return sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + 1)

    for _ in range(quality.ROUNDS):
        for i in range(width):
            p = [1 / (1 + np.exp(-total(r))) for r in range(n)]
            g, h = [y[r] - p[r] for r in range(n)], [p[r] * (1 - p[r]) for r in range(n)]
            leaves = [(0, len(tables[i]))]
            for _ in range(3):
                best = (0.0, None)
                for a, b in leaves:
                    inside = [r for r in range(n) if a <= bins[i][r] < b]
                    for cut in range(a + 1, b):
                        low = [r for r in inside if bins[i][r] < cut]
                        high = [r for r in inside if bins[i][r] >= cut]
                        if min(len(low), len(high)) >= quality.LEAST:
                            found = gain(low, g, h) + gain(high, g, h) - gain(inside, g, h)
                            if found > best[0] + 1e-9:
                                best = (found, (a, cut, b))
                if best[1] is None:
                    break
                a, cut, b = best[1]
                leaves.remove((a, b))
                leaves += [(a, cut), (cut, b)]
            for a, b in leaves:
                inside = [r for r in range(n) if a <= bins[i][r] < b]
                step = quality.RATE * sum(g[r] for r in inside) / (sum(h[r] for r in inside) + 1)
                for k in range(a, b):
                    tables[i][k] += step
    return start, tables


def test_single_tables_like_a_slow_fit(monkeypatch):
    monkeypatch.setattr(quality, "FEATURES", FEATURES[:2])
    monkeypatch.setattr(quality, "ROUNDS", 3)
    monkeypatch.setattr(quality, "PAIRS", 0)
    draw = np.random.default_rng(4)
    x = draw.normal(size=(70, 2)).astype(np.float32)
    y = (x[:, 0] + 0.5 * draw.normal(size=70) > 0).astype(float)
    start, tables = slow_fit(x, y)
    model = fit(x, y)
    assert np.isclose(model.start, start) and not model.pairs
    assert all(np.allclose(a, b) for a, b in zip(model.tables, tables))


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(300, len(FEATURES))).astype(np.float32)
    model = fit(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    for row, score in zip(x[:20], model.scores(x[:20])):
        total = model.start + sum(t[sum(e <= v for e in edges)] for v, t, edges in zip(row, model.tables, model.edges))
        total += sum(t[sum(e <= row[i] for e in model.coarse[i]), sum(e <= row[j] for e in model.coarse[j])] for i, j, t in model.pairs)
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9


def test_features_of_odd_texts():
    texts = [b"", b" \n\t", b"x", b"\n", "é".encode(), b"a b" * 50_000, b"|", b"no space"]
    found = features(texts)
    assert found.shape == (len(texts), len(FEATURES)) and np.isfinite(found).all()


def test_nulls_repeats_one_class_and_empty_tables(frame, rng):
    rows, labels = corpus(rng, 60)
    documents = frame(rows + [(None, None), (7, None), (7, ""), (None, "x")], "doc_id bigint, text string")
    marks = frame(labels + [(None, 1), (3, None), (4, 0), (4, 1), (4, 1)], "doc_id bigint, quality int")
    got = scored(documents, trained(documents, marks)).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 for r in got)
    same = trained(documents, marks.filter("quality = 1"))
    assert len({r.score for r in scored(documents, same).collect()}) == 1
    none = frame([], "doc_id bigint, text string")
    model = trained(none, frame([], "doc_id bigint, quality int"))
    assert scored(none, model).count() == 0
    assert {r.score for r in scored(documents, model).collect()} == {0.5}


def test_sample_is_bounded(frame, rng, monkeypatch):
    from millrace.llm import quality

    rows, labels = corpus(rng, 400)
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)))
    trained(frame(rows, "doc_id bigint, text string"), frame(labels, "doc_id bigint, quality int"), sample=100)
    assert 60 <= seen[0] <= 130


def test_a_repeated_id_is_one_row_of_the_sample(frame, monkeypatch):
    """An id with most of all rows sends one row to the driver, whichever task reads it."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(x.copy()))
    rows = [(1, f"text {i} of many") for i in range(3000)] + [(i, f"row {i}") for i in range(2, 200)]
    labels = frame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    for parts in (1, 5):
        trained(frame(rows, "doc_id bigint, text string", parts), labels, sample=1000)
    assert len(seen[0]) == len(seen[1]) == 199 and (seen[0] == seen[1]).all()


def test_stage_keeps_clashing_columns(frame, rng):
    rows, labels = corpus(rng, 100)
    documents = frame([(*r, 0.5, "x") for r in rows], "doc_id bigint, text string, score double, row string")
    model = trained(documents, frame(labels, "doc_id bigint, quality int"))
    kept = accepted(documents, model)
    assert kept.columns == ["doc_id", "text", "score", "row"]
    assert {tuple(r) for r in kept.collect()} <= {(*r, 0.5, "x") for r in rows}
