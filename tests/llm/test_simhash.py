import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.links import components
from millrace.llm.simhash import deduplicated, linked, near_duplicates


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def classes(values, distance=3):
    """Index of the first value that each is connected with."""
    values = np.array(values, np.int64)
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count((values ^ values[i]).view(np.uint64)) <= distance):
            a, b = label[i], label[int(j)]
            label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_texts_same_as_brute_force(frame, rng):
    words = ["Ab", "c", "é", "Ö", "x", "the", "of"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(200)) for _ in range(5)]
    texts = [None, "", " \n", "one", "One two", "one two three", " ", "ÀB c d e"]
    for text in base:
        parts = text.split(" ")
        for _ in range(8):
            parts = list(parts)
            parts[rng.randrange(200)] = "new" + str(rng.randrange(9))
            texts.append(rng.choice([" ", "\t\x0b", "\n"]).join(parts).upper())
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(100, None), (None, texts[-1]), (None, "alone here now")]
    got = near_duplicates(frame(rows, "doc_id bigint, text string")).collect()
    prints = [fingerprint(t) for _, t in rows]
    label = classes(prints)
    least = {}
    for (i, _), k in zip(rows, label):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    want = [(i, p, least.get(k)) for (i, _), p, k in zip(rows, prints, label)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def near_values(rng, groups, each):
    out = set()
    for _ in range(groups):
        value = rng.getrandbits(64)
        for _ in range(each):
            out.add(value)
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                value ^= 1 << bit
    return [v - (1 << 64) if v >> 63 else v for v in out]


@pytest.mark.parametrize("grid", [0, 1, 2])
def test_each_grid_finds_all_links(frame, rng, grid):
    values = near_values(rng, 30, 12)
    links = linked(frame([(v,) for v in values], "fp bigint"), grid=grid)
    stars = {r.a: r.b for r in components(links).collect()}
    label = classes(values)
    for i, v in enumerate(values):
        for j in range(i):
            same = stars.get(v, v) == stars.get(values[j], values[j])
            assert same == (label[i] == label[j])


def test_large_cells_go_to_finer_grids(frame, rng):
    base = rng.getrandbits(63)
    values = sorted({base ^ rng.getrandbits(12) for _ in range(600)})
    df = frame([(v,) for v in values], "fp bigint", 2)
    stars = components(linked(df, most=50, grid=0)).collect()
    label = classes(values)
    assert len({r.b for r in stars}) == sum(label.count(k) > 1 for k in set(label))
    assert len(stars) == len(values) - len(set(label))


def test_components_of_a_long_chain(frame):
    links = frame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5), (901, 900)], "a bigint, b bigint")
    got = {r.a: r.b for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 901: 900}


def test_empty_table(frame):
    assert near_duplicates(frame([], "doc_id bigint, text string")).count() == 0
    assert deduplicated(frame([], "doc_id bigint, text string")).count() == 0


def test_one_row_of_each_group_stays_whole(frame):
    rows = [(3, "a b c d", 1.0, "x"), (1, "A B c  d", 2.0, None), (1, "a b c d", 2.0, None), (2, "other words here", None, "z")]
    rows += [(None, "a b c d", 0.0, "n"), (None, "p q r s t", 0.0, "n"), (9, None, 0.0, "e"), (8, "", 0.0, "e")]
    names = "doc_id bigint, text string, fp double, uid string"
    got = deduplicated(frame(rows, names, 1))
    assert got.columns == ["doc_id", "text", "fp", "uid"]
    kept = sorted((r.doc_id is None, r.doc_id, r.text) for r in got.collect())
    assert [k[1] for k in kept] == [1, 2, 8, None]


def test_bound_of_the_embedding(spark, rng):
    values = [rng.getrandbits(63) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    for value, row in zip(values, df.select("fp", simhash._embedding(F.col("fp")).alias("e")).collect()):
        counts = [(row.e >> 2 * i) & 3 for i in range(32)]
        assert counts == [bin(row.fp >> 2 * i & 3).count("1") for i in range(32)]


@pytest.mark.parametrize("at_once", [1, 7, 64])
def test_long_texts_are_counted_in_parts(monkeypatch, rng, at_once):
    texts = [" ".join(rng.choice(["A", "b", "cc", "é"]) for _ in range(n)) for n in (0, 1, 200, 0, 2, 3, 4, 500)]
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", at_once)
    found = simhash.fingerprints([t.encode() for t in texts])
    assert found.tolist() == [fingerprint(t) for t in texts]


def test_unary_counts_give_the_manhattan_distance(rng):
    """The bound the cells are filtered by is the distance of the segment counts, and never too large."""
    values = np.array([rng.getrandbits(64) for _ in range(400)] + [0, 2**64 - 1], np.uint64)
    counts = np.array([[bin(int(v) >> (2 * i) & 3).count("1") for i in range(32)] for v in values])
    steps = simhash._steps(values)
    for i in range(0, len(values), 7):
        far = np.abs(counts - counts[i]).sum(1)
        assert (np.bitwise_count(steps ^ steps[i]) == far).all()
        assert (far <= np.bitwise_count(values ^ values[i])).all()
