import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from millrace.llm import language
from millrace.llm.language import Models, _grams, _monotone, identified, trained

SYLLABLES = {
    "aa": "the of and ing er thon wh re".split(),
    "bb": "der die ung sch ein keit ß ü".split(),
    "cc": "que los ción ñ ar ado y el".split(),
}


def texts(rng, lang, n):
    parts = SYLLABLES[lang]
    return [
        " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def models(spark):
    import random

    rng = random.Random(3)
    rows = [(t, lang) for lang in SYLLABLES for t in texts(rng, lang, 150)]
    return trained(spark.createDataFrame(rows, "text string, lang string").repartition(3))


def test_held_out_accuracy_and_calibration(frame, rng, models):
    rows = [(i, t, lang) for lang in SYLLABLES for i, t in enumerate(texts(rng, lang, 100))]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]
    got = {r.id: r for r in identified(frame(rows, "doc_id bigint, text string, lang string"), models).collect()}
    right = [got[i].lang == lang for i, _, lang in rows]
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nulls_empty_and_texts_without_letters(frame, models):
    rows = [(1, None), (2, ""), (3, "12 !? 3"), (None, "the thing and the other"), (4, "\0\0"), (5, "the of and ing " * 9000)]
    got = {r.id: r for r in identified(frame(rows, "doc_id bigint, text string"), models).collect()}
    assert [got[i].lang for i in (1, 2, 3, 4)] == ["und"] * 4
    assert [got[i].score for i in (1, 2, 3, 4)] == [0.0] * 4
    assert got[None].lang == "aa" and got[5].lang == "aa"


def test_rejection(frame, models):
    rows = [(1, "the of and thing other there"), (2, "zzz")]
    got = {r.id: r.lang for r in identified(frame(rows, "doc_id bigint, text string"), models, reject_below=0.9).collect()}
    assert got == {1: "aa", 2: "und"}


def test_empty_tables_and_no_models(frame, models):
    none = frame([], "text string, lang string")
    assert trained(none) is None
    assert trained(frame([(None, "aa"), ("text", None)], "text string, lang string")) is None
    got = identified(frame([(1, "text")], "doc_id bigint, text string"), None).collect()
    assert [(r.lang, r.score) for r in got] == [("und", 0.0)]
    assert identified(frame([], "doc_id bigint, text string"), models).count() == 0


def test_one_language_and_clashing_columns(frame):
    df = frame([(i, "some words here", "xx", 1) for i in range(40)], "doc_id bigint, text string, lang string, id int")
    got = identified(df, trained(df)).collect()
    assert {r.lang for r in got} == {"xx"} and len(got) == 40


def brute_probabilities(texts):
    """Interpolated Kneser-Ney of order four over normalised texts, with exact sequences."""
    counts = [None] * 5
    counts[4] = Counter(tuple(int(g) >> 16 * b & 0xFFFF for b in (3, 2, 1, 0)) for g in _grams(texts)[0])
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def probability(gram, n=4):
        if n == 0:
            return 1 / 0x10000
        own, total = gram[-n:], sum(c for g, c in counts[n].items() if g[:-1] == gram[-n:-1])
        if not total:
            return probability(gram, n - 1)
        kinds = sum(1 for g in counts[n] if g[:-1] == gram[-n:-1])
        once, twice = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        d = min(max(once / (once + 2 * twice), 0.1), 0.9) if once else 0.5
        return max(counts[n][own] - d, 0) / total + d * kinds / total * probability(gram, n - 1)

    return probability


def test_costs_are_kneser_ney(spark, monkeypatch):
    sample = ["ab ab abc", "Abba, cab! 42 bac", "a", "caab"]
    rows = spark.createDataFrame([(t, "x") for t in sample], "text string, lang string")
    counts = language._counted(rows)
    models = language._built(language._hashed(language._orders(counts), 22).toPandas(), ["x"], 22)
    probability = brute_probabilities(sample)
    grams = np.unique(_grams([*sample, "cc abd éa"])[0])
    for gram, cost in zip(grams, models.costs(grams)[:, 0]):
        symbols = tuple(int(gram) >> 16 * b & 0xFFFF for b in (3, 2, 1, 0))
        assert math.isclose(-math.log(probability(symbols)), cost, rel_tol=1e-4)


def test_probabilities_sum_to_one(models):
    assert isinstance(models, Models)
    letters = [*range(32, 128), *range(0xC0, 0x180)]
    rest = np.array([ord("t") << 32 | ord("h") << 16 | c for c in letters], np.uint64)
    total = np.exp(-models.costs(rest)).sum(axis=0)
    assert (total <= 1.001).all() and total[0] > 0.98


def reference_grams(text):
    """Sequences of a text by definition."""
    signs, last = [], None
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalpha():
            data = low.encode("utf-16-be")
            signs += [data[i] << 8 | data[i + 1] for i in range(0, len(data), 2)]
            last = c
        elif last is not None and signs[-1] != 32:
            signs.append(32)
    signs = [1, 1, 1, *signs]
    return [tuple(signs[i : i + 4]) for i in range(len(signs) - 3)]


LETTERS = st.text(st.sampled_from("ab A\0\n1é語\u0130") | st.characters(exclude_categories=["Cs"]), max_size=12)
FAR = st.text(st.sampled_from("\U00010001\U00020001\U00030001\U00010000\U0001F600\U00020061\U00020062ab "), max_size=12)


@settings(deadline=None, max_examples=300)
@given(st.lists(LETTERS | FAR, max_size=6))
def test_letters_of_all_planes(texts):
    grams, text, some = _grams(texts)
    for i, t in enumerate(texts):
        own = [tuple(int(g) >> 16 * b & 0xFFFF for b in (3, 2, 1, 0)) for g in grams[text == i]]
        assert own == reference_grams(t) and some[i] == any(c.isalpha() for c in t)


def test_letters_beyond_sixteen_bits(spark, frame, monkeypatch):
    assert not set(_grams(["\U00020061\U00020062"])[0]) & set(_grams(["ab"])[0])
    odd = ["\U00010001 \U00020001" * 3, "\U00030001", "\U00020001\U00020001\U00020001"]
    rows = [(t, "x") for t in odd * 20] + [("plain words", "y")] * 30
    df = frame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id bigint, text string, lang string")
    for bound in (0, language.BROADCAST_CELLS):
        monkeypatch.setattr(language, "BROADCAST_CELLS", bound)
        got = {r.id: r.lang for r in identified(df, trained(df)).collect()}
        assert got == {i: lang for i, (_, lang) in enumerate(rows)}


def test_labels_and_costs_are_the_least(spark, frame, rng):
    """The query's labels by the definition: the language whose brute-force entropy is least."""
    rows = [(t[:40], lang) for lang in ("aa", "bb") for t in texts(rng, lang, 8)]
    df = frame(rows, "text string, lang string")
    kept = [r for r in df.withColumn("o", F.pmod(F.xxhash64("text"), F.lit(16)) == 0).collect() if not r.o]
    costs = {lang: brute_probabilities([r.text for r in kept if r.lang == lang]) for lang in ("aa", "bb")}
    asked = [t[:12] for lang in SYLLABLES for t in texts(rng, lang, 4)]
    got = identified(frame(list(enumerate(asked)), "doc_id bigint, text string"), trained(df)).collect()
    for r in got:
        own = {k: -sum(math.log(p(g)) for g in reference_grams(asked[r.id])) for k, p in costs.items()}
        assert r.lang == min(own, key=lambda k: (round(own[k], 6), k))


def test_slices_of_any_size_give_the_same(frame, rng, models, monkeypatch):
    import random

    own = random.Random(3)
    rows = [(t, lang) for lang in SYLLABLES for t in texts(own, lang, 150)]
    asked = [(i, t) for i, t in enumerate(t for lang in SYLLABLES for t in texts(rng, lang, 20))] * 2
    df = frame(asked, "doc_id bigint, text string")
    want = sorted((r.id, r.lang) for r in identified(df, models).collect())
    monkeypatch.setattr(language, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(language, "TABLE_SLICE", 150)
    tables = trained(frame(rows, "text string, lang string"))
    assert sorted((r.id, r.lang) for r in identified(df, tables).collect()) == want


def test_monotone():
    assert list(_monotone(np.array([1, 9, 5]), np.array([10, 10, 10]))) == [0.1, 0.7, 0.7]


def test_no_two_sequences_share_a_place():
    grams = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 300_000).astype(np.uint64))
    assert len(np.unique(language._place(grams, 4, language.BITS))) == len(grams)


def test_tables_are_kneser_ney(spark):
    sample = ["ab ab abc", "Abba, cab! 42 bac", "a", "caab"]
    rows = spark.createDataFrame([(t, "x") for t in sample], "text string, lang string")
    tables = language._tabled(language._orders(language._counted(rows)))
    probability = brute_probabilities(sample)
    grams = np.unique(_grams([*sample, "cc abd éa"])[0]).view(np.int64)
    asked = spark.createDataFrame([(int(g),) for g in grams], "gram bigint")
    got = {r.gram: r.cost for r in tables.costs(asked).collect()}
    assert sorted(got) == sorted(grams.tolist())
    for gram, cost in got.items():
        symbols = tuple(gram >> 16 * b & 0xFFFF for b in (3, 2, 1, 0))
        assert math.isclose(-math.log(probability(symbols)), cost, rel_tol=1e-9)


def test_models_beyond_the_broadcast_bound_give_the_same(frame, rng, models, monkeypatch):
    import random

    own = random.Random(3)
    rows = [(t, lang) for lang in SYLLABLES for t in texts(own, lang, 150)]
    monkeypatch.setattr(language, "BROADCAST_CELLS", 0)
    tables = trained(frame(rows, "text string, lang string"))
    assert isinstance(tables, language.Tables)
    asked = [(i, t) for i, t in enumerate(t for lang in SYLLABLES for t in texts(rng, lang, 30))]
    asked += [(900, None), (901, ""), (902, "12 !? 3"), (None, "the thing and the other"), (903, "語 学"), (903, "語 学")]
    df = frame(asked, "doc_id bigint, text string")
    want = sorted((tuple(r) for r in identified(df, models).collect()), key=repr)
    got = sorted((tuple(r) for r in identified(df, tables).collect()), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.mean([abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want)]) > 0.95
    assert trained(frame([], "text string, lang string")) is None
