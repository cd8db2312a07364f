"""Near-duplicates at 0.8: against all pairs."""

import random

import numpy as np
import pytest

from millrace.llm import similar
from millrace.llm.similar import (
    bits_apart,
    candidates,
    class_cells,
    deduplicated,
    left_out,
    long_fingerprints,
    shingle_sets,
    similar_links,
)


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def variants(rng, words, share):
    """A text and copies of it in which about `share` of the words are changed, dropped or added."""
    out = [words]
    for _ in range(3):
        copy = []
        for w in words:
            kind = rng.random() / share
            copy += [w] if kind > 1 else [f"n{rng.randrange(10**6)}"] if kind < 0.4 else [w, "x"] if kind < 0.7 else []
        # Short texts stay similar only if they differ at an end.
        out.append(copy if rng.random() < 0.5 else [*words, f"n{rng.randrange(10**6)}"][rng.randrange(2) :])
    return [" ".join(w) for w in out]


def corpus(rng, groups, sizes, shares=(0.002, 0.005, 0.01, 0.02, 0.03)):
    texts = []
    for _ in range(groups):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice(sizes))]
        texts += variants(rng, words, rng.choice(shares))
    return texts


def pairs_of(texts, least=0.8):
    sets = shingle_sets([t.encode() for t in texts])
    owners = {}
    for i, s in enumerate(sets):
        for h in s.tolist():
            owners.setdefault(h, []).append(i)
    near = {(i, j) for group in owners.values() for x, i in enumerate(group) for j in group[x + 1 :]}
    return {(i, j) for i, j in near if jaccard(sets[i], sets[j]) >= least}


def groups_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("sizes", [[8, 12, 20], [30, 50, 90], [150, 300, 600], [2000]])
def test_pairs_at_the_bound_share_cells(rng, sizes):
    """Of pairs of a similarity of 0.8 and more, nine in ten and more share a cell, whatever their length."""
    texts = corpus(rng, max(12, 6000 // sizes[0]), sizes)
    sets = shingle_sets([t.encode() for t in texts])
    cells = [set(x) for x in class_cells(sets)]
    pairs = [(i, j) for i, j in pairs_of(texts) if not np.array_equal(sets[i], sets[j])]
    close = [(i, j) for i, j in pairs if jaccard(sets[i], sets[j]) < 0.88]
    for some in (pairs, close):
        assert len(some) >= 5 and np.mean([bool(cells[i] & cells[j]) for i, j in some]) >= 0.9
    assert all(len(x) <= 2 * similar.CLASSES for x in cells)


def test_groups_are_those_of_all_pairs(frame, rng):
    texts = corpus(rng, 120, [9, 25, 60, 200])
    texts += [texts[0].upper(), texts[0], "", None, " \n", "a b", "A  b", "a c"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id for r in deduplicated(frame(rows, "doc_id bigint, text string", 5)).collect()}
    plain = [t or "" for t in texts]
    same = {}
    exact = [(same.setdefault(tuple(t.lower().split()), i), i) for i, t in enumerate(plain)]
    groups = groups_of(len(texts), [*pairs_of([t.lower() for t in plain]), *exact])
    want = set(groups)
    # What stays is one row of each group; a few links at the bound may not be found.
    assert want <= got and len(got - want) <= 0.1 * (len(texts) - len(want))


def test_a_line_that_a_third_of_all_texts_have(frame, rng, monkeypatch):
    """Cells of a common line go to finer cells; texts that only share the line stay."""
    monkeypatch.setattr(similar, "FEW", 4)
    line = "all rights reserved by the owner of this page see terms"
    texts = [line + " " + " ".join(f"u{i}x{j}" for j in range(rng.randint(3, 12))) for i in range(150)]
    texts += [line + " tail" * (i % 3) for i in range(30)]
    near = [line + " " + " ".join(f"s{j}" for j in range(60)) + f" end{i}" for i in range(60)]
    got = {r.doc_id for r in deduplicated(frame(list(enumerate(texts + near)), "doc_id bigint, text string")).collect()}
    want = set(groups_of(len(texts) + len(near), [*pairs_of(texts + near), *[(150 + i % 3, 150 + i) for i in range(30)]]))
    assert want <= got and len(got - want) <= 2
    assert len([i for i in got if i >= 180]) == 1


def test_no_link_is_made_of_texts_that_are_not_similar(frame, spark):
    rng = random.Random(5)
    texts = corpus(rng, 80, [10, 40, 120], shares=(0.03, 0.06, 0.1))
    sets = shingle_sets([t.encode() for t in texts])
    df = frame([(i, t) for i, t in enumerate(texts)], "uid bigint, text string")
    cells = [[{"k": k, "cell": c} for k, c in x] for x in class_cells(sets)]
    reps = spark.createDataFrame(list(enumerate(cells)), "uid bigint, cells array<struct<k:int,cell:bigint>>")
    links = {(r.a, r.b) for r in similar_links(reps, df).collect()}
    assert links and all(jaccard(sets[a], sets[b]) >= 0.8 for a, b in links)


@pytest.mark.parametrize("sizes", [[8, 9, 10], [12, 20], [40, 90], [400]])
def test_similar_texts_are_near_by_their_fingerprints(rng, sizes):
    texts = corpus(rng, max(12, 4000 // sizes[0]), sizes)
    sets = shingle_sets([t.encode() for t in texts])
    fps, (most, _) = long_fingerprints(sets), bits_apart(np.array([len(x) for x in sets]), 0.8)
    pairs = [(i, j) for i, j in pairs_of(texts) if jaccard(sets[i], sets[j]) < 0.95]
    far = [int(np.bitwise_count(fps[i] ^ fps[j]).sum()) > max(most[i], most[j]) for i, j in pairs]
    assert len(pairs) >= 10 and np.mean(far) <= 0.002
    others = [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(2000)]
    others = [(i, j) for i, j in others if jaccard(sets[i], sets[j]) < 0.4 and min(len(sets[i]), len(sets[j])) > 3]
    assert np.mean([int(np.bitwise_count(fps[i] ^ fps[j]).sum()) > max(most[i], most[j]) for i, j in others]) >= 0.99


def members(texts, cell=0, old=False):
    sets = shingle_sets([t.encode() for t in texts])
    n, sizes = len(texts), np.array([len(x) for x in sets])
    return similar._Rows(np.full(n, cell), np.zeros(n, int), np.arange(n), sizes, long_fingerprints(sets), np.full(n, old))


@pytest.mark.parametrize("few", [0, 12])
def test_pairs_of_a_cell(rng, few):
    """All near pairs of a small cell; in a large one each text meets a leader, and few of them."""
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[: 200 - i % 5]) + f" e{i}" for i in range(6)] + [" ".join(f"o{i}x{j}" for j in range(50)) for i in range(3)]
    i, j, aside, leaders = candidates(members(texts), 0.8, few, 2, 8)
    pairs = set(zip(i.tolist(), j.tolist()))
    if few:
        assert pairs == {(x, y) for y in range(6) for x in range(y)} and not aside.any()
    else:
        assert pairs == {(0, y) for y in range(1, 6)} and aside.tolist() == [False] + [True] * 5 + [False] * 3
        assert leaders.tolist() == [True] + [False] * 5 + [True] * 3
        # Without a place the others go on.
        assert candidates(members(texts), 0.8, 0, 2, 2)[2].tolist() == [False] + [True] * 5 + [False, True, True]


@pytest.mark.parametrize("most", [3, 4096])
def test_only_near_texts_are_compared_and_pairs_do_not_grow_with_the_square(frame, rng, monkeypatch, most):
    """A line in half of all texts, and many near copies of one text, some of them less similar than asked."""
    monkeypatch.setattr(similar, "MOST", most)
    compared, plain = [], similar._similar
    monkeypatch.setattr(similar, "_similar", lambda pairs, *more: compared.append(pairs.count()) or plain(pairs, *more))
    line = "all rights reserved by the owner of this page see terms"
    texts = [line + " " + " ".join(f"u{i}x{j}" for j in range(40)) for i in range(150)]
    base = [f"s{j}" for j in range(150)]
    near = [" ".join(w if rng.random() > 0.012 else f"n{rng.randrange(10**6)}" for w in base) for _ in range(150)]
    rows = list(enumerate(texts + near))
    got = {r.doc_id for r in deduplicated(frame(rows, "doc_id bigint, text string")).collect()}
    groups = groups_of(300, pairs_of(texts + near))
    assert set(groups) <= got and len(got) - len(set(groups)) <= 8
    # All cells share few pairs; before, all texts of the line were compared with one another.
    assert 0 < sum(compared) < 150 * 64


def links_in_one_cell(frame, spark, texts, k=similar.CLASSES - 1):
    """Links of texts that share one cell, of the last class, and no other."""
    reps = spark.createDataFrame([(i, [(k, 7)]) for i in range(len(texts))], "uid bigint, cells array<struct<k:int,cell:bigint>>")
    df = frame(list(enumerate(texts)), "uid bigint, text string")
    return {(r.a, r.b) for r in similar_links(reps, df).collect()}


def chain(rng, name, n, step, width=100):
    """Each text is like the next ones only; in any order."""
    texts = [" ".join(f"{name}{j}" for j in range(i * step, i * step + width)) for i in range(n)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("few, leaders, most", [(12, 1024, 4096), (0, 4, 4096), (4, 2, 16), (12, 4, 5)])
def test_what_leaders_leave_out_is_compared(frame, spark, rng, monkeypatch, few, leaders, most):
    """All texts of a cell that are linked by pairs are linked, in large and in crowded cells."""
    for name, value in (("FEW", few), ("LEADERS", leaders), ("MOST", most)):
        monkeypatch.setattr(similar, name, value)
    texts = chain(rng, "p", 40, 3) + chain(rng, "q", 30, 9) + [" ".join(f"o{i}x{j}" for j in range(50)) for i in range(20)]
    pairs = pairs_of(texts)
    links = links_in_one_cell(frame, spark, texts)
    assert links <= pairs and len(set(groups_of(len(texts), pairs))) == 22
    assert groups_of(len(texts), links) == groups_of(len(texts), pairs)


def test_a_common_line_in_a_crowded_cell_of_the_last_class(frame, spark, rng, monkeypatch):
    """Similar pairs among many texts that have nothing but a line in common."""
    monkeypatch.setattr(similar, "LEADERS", 8)
    monkeypatch.setattr(similar, "MOST", 16)
    line = "all rights reserved by the owner of this page see terms"
    texts = []
    for i in range(60):
        words = [f"u{i}x{j}" for j in range(rng.randint(30, 60))]
        texts += [line + " " + " ".join(words), line + " " + " ".join([*words, "end"])]
    rng.shuffle(texts)
    links = links_in_one_cell(frame, spark, texts)
    assert links == pairs_of(texts) and len(links) == 60


def test_near_copies_in_a_crowded_cell_without_a_leader(frame, spark, monkeypatch):
    """Where other texts take all leaders' places, near copies are still linked by few pairs."""
    compared, plain = [], similar._similar
    monkeypatch.setattr(similar, "_similar", lambda pairs, *more: compared.append(pairs.count()) or plain(pairs, *more))
    monkeypatch.setattr(similar, "LEADERS", 8)
    monkeypatch.setattr(similar, "MOST", 300)
    line = "all rights reserved by the owner of this page see terms"
    texts = [line + " " + " ".join(f"u{i}x{j}" for j in range(40)) for i in range(200)]
    texts += [" ".join(f"s{j}" for j in range(100)) + f" t{i} x{i}" for i in range(200)]
    assert len(set(groups_of(400, links_in_one_cell(frame, spark, texts)))) == 201
    assert sum(compared) < 200 * 20


@pytest.mark.parametrize("few", [0, 12])
def test_pairs_of_two_groups(rng, few):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[: 200 - i]) + f" e{i}" for i in range(6)]
    rows = members(texts)
    rows.root[:] = [0, 0, 0, 3, 3, 5]

    def got(most):
        out = list(left_out(rows, 0.8, few, most))
        return {(i, j) for x, y, _ in out for i, j in zip(x.tolist(), y.tolist())}, [i for *_, more in out for i in more.tolist()]

    every = {(i, j) for j in range(6) for i in range(j) if rows.root[i] != rows.root[j]}
    assert got(None) == (every, [])
    some, more = got(1)
    if few:
        assert some == every and not more
    else:
        assert len(some) == 3 and some < every and more == list(range(6))
        assert got(6) == (every, [])
        # Of each row the nearest before it.
        assert got(0) == ({(2, 3), (2, 4), (4, 5)}, list(range(6)))
    # Of a cell of two parts only pairs of both come.
    rows.k[:] = [1, 1, 2, 1, 2, 2]
    assert got(None)[0] == {(i, j) for i, j in every if rows.k[i] != rows.k[j]}
    assert few or got(0) == (set(), list(range(6)))


def test_texts_of_one_shingle(frame):
    texts = ["y " * 5, "y " * 9, "Y " * 30, "y " * 4, "z " * 7, "a b c d e", "a b c d e a b c d e"]
    got = {r.doc_id for r in deduplicated(frame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {0, 3, 4, 5, 6}


def test_nulls_repeats_and_clashing_columns(frame):
    names = "doc_id bigint, text string, uid string, row int, cells string"
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(None, long, "a", 1, "c"), (9, long + " more", "b", 2, "c"), (4, "x " + long, "c", None, "c"), (4, long, "d", 4, None)]
    rows += [(None, None, None, None, None), (7, "other words", "e", 5, "c"), (7, "other words", "f", 6, "c")]
    got = deduplicated(frame(rows, names, 1))
    assert got.columns == ["doc_id", "text", "uid", "row", "cells"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[2], rows[4], rows[5]], key=repr)
    assert deduplicated(frame([], names)).count() == 0
    assert deduplicated(frame([(1, "y " * 40_000 + long)], "doc_id int, text string")).count() == 1
