import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import substrings
from millrace.llm.substrings import repeats_removed, without_repeats

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, size):
    lists = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, words in lists:
        if i is not None:
            for k in range(len(words) - size + 1):
                w = tuple(words[k : k + size])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, words in lists:
        gone = set()
        for k in range(len(words) - size + 1):
            if i is not None and first[tuple(words[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), kept))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(rng, size, words):
    """Texts that share passages, some made of very few words, so that runs and periods occur."""
    vocabulary = [f"w{i}" for i in range(words)]
    parts = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 3 * size))] for _ in range(12)]
    parts += [[rng.choice(vocabulary)] * rng.randint(1, 3 * size) for _ in range(4)]
    parts += [[rng.choice(vocabulary), rng.choice(vocabulary)] * rng.randint(1, 2 * size) for _ in range(3)]
    texts = []
    for _ in range(60):
        words = [w for _ in range(rng.randint(0, 4)) for w in rng.choice(parts)]
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    return texts


@pytest.mark.parametrize("size,words", [(50, 2), (50, 40), (50, 5000), (8, 3), (8, 200), (2, 4), (1, 3)])
def test_same_as_brute_force(frame, rng, size, words):
    rows = list(enumerate(corpus(rng, size, words)))
    got = rows_of(without_repeats(frame(rows, "doc_id bigint, text string"), size=size))
    assert got == brute(rows, size)


def test_joins_by_shuffle_give_the_same(frame, rng, monkeypatch):
    rows = list(enumerate(corpus(rng, 20, 30)))
    monkeypatch.setattr(substrings, "BROADCAST_NUMBERS", 0)
    assert rows_of(without_repeats(frame(rows, "doc_id bigint, text string"), size=20)) == brute(rows, 20)


def test_nulls_empty_texts_repeated_rows_and_ids(frame):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [(None, long), (3, long), (3, long), (5, "a " + long), (3, long + " b"), (4, None), (6, ""), (7, " \n")]
    rows += [(None, None), (8, long), (9, "\x85 " + long)]
    got = rows_of(without_repeats(frame(rows, "doc_id bigint, text string")))
    assert got == brute(rows, 50)


def test_texts_of_one_id_with_the_same_short_hash(spark, frame):
    """Rows of one id are told apart, also where 32 bits of their texts are the same."""
    passage, clean = (" ".join(f"{c}{i}" for i in range(60)) for c in "xy")
    heads = spark.range(200_000).select(F.concat(F.lit(passage + " s"), "id").alias("a"), F.concat(F.lit(clean + " z"), "id").alias("b"))
    a = heads.select("a", F.hash("a").alias("h"))
    one = a.join(heads.select("b", F.hash("b").alias("h")), "h").first()
    assert one is not None
    rows = [(1, passage), (2, one.a), (2, one.b)]
    assert rows_of(without_repeats(frame(rows, "doc_id bigint, text string"))) == brute(rows, 50)


def test_empty_table(frame):
    assert without_repeats(frame([], "doc_id bigint, text string")).count() == 0
    assert repeats_removed(frame([], "doc_id bigint, text string")).count() == 0


def test_long_text_and_slices(frame, rng, monkeypatch):
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(70))
    rows = [(0, passage), (1, " ".join(f"q{i}" for i in range(200_000)) + " " + passage), (2, "z " + passage)]
    got = rows_of(without_repeats(frame(rows, "doc_id bigint, text string", 1)))
    assert got == brute(rows, 50)


def test_stage_keeps_clean_rows_and_clashing_columns(frame):
    long = " ".join(f"x{i}" for i in range(60))
    rows = [
        (1, long, "s", 1, "k"), (2, "new  words\there", "s", 16, "k"), (3, "one two " + long, None, 9, "k"),
        (4, long, "t", 1, "k"), (5, None, "t", None, None), (None, long, "u", 3, "k"),
    ]
    names = ["doc_id", "text", "id", "n_chars", "row"]
    got = repeats_removed(frame(rows, "doc_id bigint, text string, id string, n_chars bigint, row string"))
    assert got.columns == names
    assert rows_of(got) == sorted(
        [(3, "one two", None, 7, "k") if r[0] == 3 else r for r in rows if r[0] != 4], key=repr
    )
