import numpy as np
import pytest

from millrace.llm import neighbours
from millrace.llm.neighbours import nearest_neighbours

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, asked, nearest=10):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v]
    good = {i: v for i, v in good if np.isfinite(v).all() and v.any()}
    out = []
    for q in asked:
        if q in good:
            found = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(found[:nearest])]
    return out


def run(frame, rows, **more):
    df = frame(rows, SCHEMA)
    got = nearest_neighbours(df, df.filter("vec_id % 10 = 0"), **more).collect()
    return sorted((r["query"], r["rank"], r["id"], r["distance"]) for r in got)


def vectors(n, size=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    return [(i, (centres[i % 5] + rng.normal(size=size)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("slot_rows", [20_000, 60])
def test_recall(frame, monkeypatch, slot_rows):
    monkeypatch.setattr(neighbours, "SLOT_ROWS", slot_rows)
    rows = vectors(800)
    want = brute(rows, range(0, 800, 10))
    got = run(frame, rows)
    exact = {(q, i): d for q, _, i, d in brute(rows, range(0, 800, 10), 800)}
    assert all(abs(exact[q, i] - d) < 1e-12 for q, _, i, d in got)
    hits = {w[::2][:2] for w in want} & {g[::2][:2] for g in got}
    assert len(hits) >= 0.93 * len(want)


def test_many_equal_vectors_are_exact(frame):
    rows = vectors(100) + [(i, [1.0] * 16) for i in range(100, 400)] + [(100, [1.0] * 16)]
    got = [g for g in run(frame, rows) if 100 <= g[0] < 400]
    assert got == [w for w in sorted(brute(rows, range(100, 400, 10)))]


def test_what_takes_no_part(frame):
    rows = vectors(40) + [(50, None), (60, [0.0] * 16), (70, [float("nan")] * 16), (80, [None] + [1.0] * 15)]
    rows += [(90, [float("inf")] * 16), (None, [1.0] * 16), (110, [1.0, 2.0]), (120, [])]
    got = run(frame, rows, recall=0.9999)
    assert [g[:3] for g in got] == [w[:3] for w in sorted(brute(rows[:40], range(0, 40, 10)))]


def test_few_rows_and_empty_table(frame):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (10, [0.0, 1.0])]
    assert [g[:3] for g in run(frame, rows, recall=0.9999)] == [(0, 1, 1), (0, 2, 10), (10, 1, 1), (10, 2, 0)]
    assert run(frame, rows[:1]) == [] and run(frame, []) == []


def test_clashing_columns(frame):
    df = frame([(i, [float(i), 1.0], i, "x") for i in range(20)], SCHEMA + ", id int, bucket string")
    got = nearest_neighbours(df, df.filter("vec_id = 0"), recall=0.9999).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, 11))


@pytest.mark.parametrize("n", [3, 12])
def test_tiny_tables_are_whole(frame, n):
    rows = vectors(n)
    assert [g[:3] for g in run(frame, rows)] == [w[:3] for w in sorted(brute(rows, range(0, n, 10)))]


@pytest.mark.parametrize(("n", "outliers"), [(30, 2), (400, 12)])
def test_outliers_get_their_nearest(frame, monkeypatch, n, outliers):
    monkeypatch.setattr(neighbours, "SLOT_ROWS", 60)
    far = np.random.default_rng(5).normal(size=(outliers, 16))
    rows = vectors(n) + [(1000 + 10 * i, (v * 10 ** (1 + i % 4)).tolist()) for i, v in enumerate(far)]
    got = [g for g in run(frame, rows) if g[0] >= 1000]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(brute(rows, range(1000, 1000 + 10 * outliers, 10)))]


def test_queries_of_a_slot_are_dealt_over_blocks(frame, monkeypatch):
    rows, most = vectors(800), []
    want = run(frame, rows)
    searched = neighbours._searched

    def seen(df, keep):
        most.append(df.filter("kind = 0").groupBy("slot").count().agg({"count": "max"}).first()[0])
        return searched(df, keep)

    monkeypatch.setattr(neighbours, "_searched", seen)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7, raising=False)
    assert run(frame, rows) == want
    assert most and max(most) <= 30
