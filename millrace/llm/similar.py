"""Near-duplicates by a similarity of shingle sets, over SimHash fingerprints of classes of shingles.

One fingerprint of a whole text says little at a similarity of 0.8: a sixth of its
bits differ. So the set of a text's shingles is dealt into classes by a hash, of a
few shingles each, and every class has a fingerprint of its own, embedded as the
bit counts of its segments. Texts whose shingles are mostly the same have several
classes that are the same throughout: their embeddings are at distance zero and
fall into one cell. The number of classes follows from the size of the set, in powers
of two; a text near the next power is in the cells of both. The first `CLASSES`
classes count, so a text of any length is in a bounded number of cells.

What share a cell are compared by SimHash: every text also has one long fingerprint of
all its shingles, embedded as the bit counts of its segments. The Manhattan distance of
two embeddings bounds the Hamming distance from below, so it filters first; then the
fingerprints are verified to differ in no more bits than two texts of the similarity
asked for do. What is left is verified by the exact similarity of the sets, each
comparison being a row of a Spark join.

In a cell of few texts all pairs are compared. In others, texts are first compared with
the leaders of the cell, in the order of ids: a text becomes a leader unless its
fingerprint says that it is like one, or it is near to `TRIES` of them. So most of what
belongs together is linked by pairs that grow with the texts, not with their square.

That leaves out pairs of texts that were set aside. So the links found are followed to
their ends, and cells in which a text was set aside and which are of more than one
group go on: pairs of texts of two groups that are near are compared, those of a text
with its nearest first, then the nearest of each two groups, and in the last round all
that there are. Texts that one group already holds need no comparison. When the rounds end, every pair that shares a cell and
is near has been compared or is in one group; no cell is capped and none is left.

Cells too large to compare in one task, as where a common line is all that a class holds,
go on as cells of single shingles instead. Two texts of the similarity asked for share a
shingle among the rarest of each, a fifth at 0.8, whatever else they hold (the prefix
filter, which is exact), so a common line stops bringing texts together and no pair is
lost. Those that are still large are cut in parts, and every two parts meet.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.common import arrow_batches, packed, text_slices, utf8, write_once
from millrace.llm.links import components
from millrace.llm.simhash import _hashes, _set_bits, _steps

WORDS = 5
SIMILAR = 0.8
CLASSES = 16
# Shingles of a class, at least, where there are enough for eight classes.
LEAST = 3
# Words of 64 bits of a text's long fingerprint.
LONG = 16
# Texts of a cell all of whose pairs are compared.
FEW = 12
# Leaders that a text is verified with, at most, before it is set aside.
TRIES = 16
# Leaders of a cell, at most, of those that a task holds at once.
LEADERS = 1024
# Rows of a cell that a task holds before it compares them; of what it has compared it holds the leaders.
# Cells of more go on as cells of shingles, and in parts of so many.
MOST = 4096
# Pairs of each two groups that are compared in the rounds after the leaders, the nearest first; at last all.
# In the round of 0 each text is compared with the nearest one before it.
ROUNDS = (0, 4, 64, None)
# Pairs of a large cell whose fingerprints are compared at once.
AT_ONCE = 1 << 15
# Rows of one or two numbers that are broadcast, at most; beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000
_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted hashes."""
    return [np.unique(_hashes(t, words)) for t in texts]


def _powers(sizes: np.ndarray) -> np.ndarray:
    """The logarithm of the number of classes for sets of these sizes; does not fall with the size."""
    sizes = np.maximum(sizes, 1)
    few = np.minimum(3, np.floor(np.log2(sizes)))
    return np.maximum(few, np.floor(np.log2(np.maximum(sizes / LEAST, 1)))).astype(np.int64)


def class_cells(sets: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """(number of class, cell) of each set, by number; empty sets have none."""
    out: list[list[tuple[int, int]]] = [[] for _ in sets]
    if not sets:
        return out
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    hashes = np.concatenate(sets)
    text = np.repeat(np.arange(len(sets)), sizes)
    low, high = _powers(sizes), _powers(np.floor(sizes / SIMILAR).astype(np.int64))
    mixed = _mixed(hashes)
    for power, some in ((low, sizes > 0), (high, high != low)):
        number = mixed & ((_U(1) << power[text].astype(_U)) - _U(1))
        take = np.flatnonzero(some[text] & (number < _U(CLASSES)))
        if not len(take):
            continue
        # Neighbouring powers have numbers of their own.
        number = number[take].astype(np.int64) + CLASSES * (power[text[take]] & 1)
        group = text[take] * (2 * CLASSES) + number
        order = np.argsort(group, kind="stable")
        groups, owner, size = np.unique(group[order], return_inverse=True, return_counts=True)
        counts = _set_bits(hashes[take][order], owner, len(groups))
        fps = np.packbits(counts * 2 > size[:, None], axis=1).view(">u8").ravel().astype(_U)
        own = groups // (2 * CLASSES)
        mark = (power[own] * (2 * CLASSES) + groups % (2 * CLASSES)).astype(_U)
        cells = _mixed(_steps(fps) ^ _mixed(mark + _U(1))).view(np.int64)
        for i, k, cell in zip(own.tolist(), (groups % (2 * CLASSES)).tolist(), cells.tolist()):
            out[i].append((k, cell))
    return [sorted(x) for x in out]


def _surveyed(rows: DataFrame, words: int) -> DataFrame:
    """uid, id, a digest of the words, and the cells, for every row (uid, id, text)."""
    cell = pa.list_(pa.struct([("k", pa.int32()), ("cell", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in text_slices(texts):
                some = texts[a:b]
                whole = b"".join(xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in some)
                whole = np.frombuffer(whole, "<i8").reshape(-1, 2)
                cells = class_cells(shingle_sets(some, words))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("uid").slice(a, b - a),
                        batch.column("id").slice(a, b - a),
                        pa.array(whole[:, 0]),
                        pa.array(whole[:, 1]),
                        pa.array([[{"k": k, "cell": c} for k, c in x] for x in cells], cell),
                    ],
                    ["uid", "id", "d1", "d2", "cells"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"uid bigint, id {kind}, d1 bigint, d2 bigint, cells array<struct<k:int,cell:bigint>>")


def long_fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A fingerprint of `LONG` words for each set."""
    out = np.zeros((len(sets), LONG), _U)
    if not sets:
        return out
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    for i in range(LONG):
        counts = _set_bits(_mixed(hashes ^ _U((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), owner, len(sets))
        out[:, i] = np.packbits(counts * 2 > sizes[:, None], axis=1).view(">u8").ravel()
    return out


def bits_apart(sizes: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """Bits in which texts of these numbers of shingles differ at most, and surely, at this similarity.

    A bit differs with the chance of the angle of the sets over pi, and in small sets,
    where counts tie, with up to one part in their size more. The first bound adds four
    standard deviations, the second takes two off.
    """
    bits, chance = 64 * LONG, math.acos(min(1.0, 2 * least / (1 + least))) / math.pi
    spread = math.sqrt(bits * chance * (1 - chance))
    return bits * chance * (1 + 1 / np.maximum(sizes, 1)) + 4 * spread, bits * chance - 2 * spread


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """uid, the set of shingles and the long fingerprint of rows (uid, text)."""

    def run(batches):
        for batch in batches:
            texts = utf8(batch.column("text"))
            for a, b in text_slices(texts):
                sets = shingle_sets(texts[a:b], words)
                edges = np.cumsum([0, *map(len, sets)])
                values = pa.array(np.concatenate(sets).view(np.int64))
                found = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)
                fps = pa.array([x.tobytes() for x in long_fingerprints(sets)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").slice(a, b - a), found, fps], ["uid", "shingles", "fp"]
                )

    return rows.select("uid", "text").mapInArrow(run, "uid bigint, shingles array<bigint>, fp binary")


def _small(df: DataFrame) -> DataFrame:
    """A written table of numbers, marked to be broadcast if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b and whether their sets have a similarity of `least`, for distinct pairs.

    The sets stay where they are: pairs come to them, once for either side, and only
    the sets of pairs travel.
    """
    pairs = _small(write_once(pairs.select("a", "b").distinct(), "pairs"))
    one = sets.select(F.col("uid").alias("a"), F.col("shingles").alias("x")).join(pairs, "a")
    two = sets.select(F.col("uid").alias("b"), F.col("shingles").alias("y")).join(pairs, "b")
    joined = one.join(two, ["a", "b"]).withColumn("both", F.size(F.array_intersect("x", "y")))
    union = F.size("x") + F.size("y") - F.col("both")
    return joined.select("a", "b", (F.col("both") >= F.lit(least) * union).alias("same"))


class _Rows:
    """Members of cells, in the order of cell, k and uid; `old` ones are leaders of rows before.

    `k` is 0, or which of the two parts that meet in a cell a row is of; rows of one
    `root` are in one group already.
    """

    def __init__(self, cell, k, uid, size, fp, old, root=None):
        root = uid if root is None else root
        self.columns = (cell, k, uid, size, fp, old, root)
        self.cell, self.k, self.uid, self.size, self.fp, self.old, self.root = self.columns

    @staticmethod
    def of(batch) -> _Rows:
        fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), _U).reshape(-1, LONG)
        cell, k, uid, size, root = [batch.column(c).to_numpy() for c in ("cell", "k", "uid", "size", "root")]
        return _Rows(cell, k, uid, size, fps, np.zeros(len(fps), bool), root)

    def __len__(self) -> int:
        return len(self.uid)

    def some(self, which) -> _Rows:
        return _Rows(*[c[which] for c in self.columns])

    def then(self, other: _Rows) -> _Rows:
        return _Rows(*[np.concatenate(x) for x in zip(self.columns, other.columns)])

    def borders(self) -> tuple[np.ndarray, np.ndarray]:
        """Where cells begin and end."""
        heads = np.flatnonzero(np.concatenate(([True], self.cell[1:] != self.cell[:-1])))
        return heads, np.append(heads[1:], len(self))


def _nearness(rows: _Rows, least: float):
    """A function that says which of some pairs of rows are near, and their distances; and the sure distance.

    Sets of the similarity asked for are as near in size; then their fingerprints decide.
    """
    steps, (most, surely) = _steps(rows.fp), bits_apart(rows.size, least)

    def near(i, j):
        bound = np.maximum(most[i], most[j])
        alike = np.minimum(rows.size[i], rows.size[j]) >= least * np.maximum(rows.size[i], rows.size[j])
        at = np.flatnonzero(alike)
        one = i if np.ndim(i) == 0 else i[at]
        at = at[np.bitwise_count(steps[one] ^ steps[j[at]]).sum(1) <= bound[at]]
        one = i if np.ndim(i) == 0 else i[at]
        far = np.bitwise_count(rows.fp[one] ^ rows.fp[j[at]]).sum(1)
        return at[far <= bound[at]], far[far <= bound[at]]

    return near, surely


def candidates(rows: _Rows, least: float, few: int, tries: int, most_leaders: int):
    """Pairs near by their fingerprints, as rows i and j; rows that are set aside; leaders.

    All pairs of a cell of `few` rows; in others, pairs with leaders.
    """
    near, surely = _nearness(rows, least)
    heads, ends = rows.borders()
    small = (ends - heads <= few) & ~rows.old[heads]
    of_small = np.repeat(small, ends - heads)
    left, right, aside, leaders = [], [], np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    for step in range(1, few):
        i = np.flatnonzero(of_small[:-step] & (rows.cell[:-step] == rows.cell[step:]))
        if not len(i):
            break
        i = i[near(i, i + step)[0]]
        left.append(i)
        right.append(i + step)
    for head, end in zip(heads[~small].tolist(), ends[~small].tolist()):
        waiting, tried, places = np.ones(end - head, bool), np.zeros(end - head, np.int64), most_leaders
        for i in range(head, end):
            if not waiting[i - head]:
                continue
            if not places:
                break
            waiting[i - head], leaders[i], places = False, True, places - 1
            j = np.flatnonzero(waiting[i + 1 - head :] & ~rows.old[i + 1 : end]) + i + 1
            at, far = near(i, j)
            j = j[at]
            left.append(np.full(len(j), i))
            right.append(j)
            tried[j - head] += 1
            done = j[(far <= surely) | (tried[j - head] >= tries)]
            waiting[done - head], aside[done] = False, True
        aside[head:end] |= waiting
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), aside, leaders


def _dealt(members: DataFrame) -> DataFrame:
    """Members of cells, with those of a cell in one task, in order."""
    members = members.select("cell", "k", "uid", "size", "fp", "root")
    return members.repartition("cell").sortWithinPartitions("cell", "k", "uid")


def _met(members: DataFrame, least: float) -> DataFrame:
    """cell, a, b, aside: pairs of each cell that are near by their fingerprints.

    Where a member was set aside, pairs of its cell are left out. Those without a pair
    come with no a.
    """
    few, tries, places, most = FEW, TRIES, LEADERS, MOST

    def found(rows, few):
        i, j, aside, leaders = candidates(rows, least, few, tries, places)
        alone = aside.copy()
        alone[j] = False
        alone = np.flatnonzero(alone)
        b = np.concatenate((j, alone))
        a = np.concatenate((rows.uid[i], np.zeros(len(alone), np.int64)))
        a = pa.array(a, mask=np.arange(len(a)) >= len(i))
        columns = [pa.array(rows.cell[b]), a, pa.array(rows.uid[b]), pa.array(aside[b])]
        return pa.RecordBatch.from_arrays(columns, ["cell", "a", "b", "aside"]), leaders

    def run(batches):
        held = None
        for batch in batches:
            held = _Rows.of(batch) if held is None else held.then(_Rows.of(batch))
            if not len(held):
                continue
            last = int(np.searchsorted(held.cell, held.cell[-1], "left"))
            if last:
                yield found(held.some(slice(0, last)), few)[0]
                held = held.some(slice(last, None))
            if len(held) > most:
                out, leaders = found(held, 0)
                yield out
                held = held.some(np.flatnonzero(leaders))
                held.old[:] = True
        if held is not None and len(held):
            yield found(held, few)[0]

    return _dealt(members).mapInArrow(run, "cell bigint, a bigint, b bigint, aside boolean")


def left_out(rows: _Rows, least: float, few: int, most: int | None):
    """Near pairs of rows of one cell and two roots, as rows i and j, in pieces, and rows of cells that have more.

    Of each two roots at least the `most` nearest pairs come, or all if it is None; all,
    too, in cells of `few` rows. If it is 0, each row comes with the nearest before it,
    and cells of two parts wait.
    """
    near, _ = _nearness(rows, least)
    none = np.empty(0, np.int64)

    def pairs(i, j):
        """Those to compare, and their distances."""
        at = np.flatnonzero((rows.root[i] != rows.root[j]) & ((rows.k[i] == 0) | (rows.k[i] != rows.k[j])))
        ok, far = near(i[at], j[at])
        return i[at[ok]], j[at[ok]], far

    def nearest(i, j, far):
        low, high = (rows.root[i], rows.root[j]) if most else (j, j)
        low, high = np.minimum(low, high), np.maximum(low, high)
        order = np.lexsort((j, i, far, high, low))
        low, high, at = low[order], high[order], np.arange(len(order))
        first = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        order = order[at - np.maximum.accumulate(np.where(first, at, 0)) < (most or 1)]
        return i[order], j[order], far[order]

    heads, ends = rows.borders()
    small = ends - heads <= few
    of_small = np.repeat(small, ends - heads)
    for step in range(1, few):
        i = np.flatnonzero(of_small[:-step] & (rows.cell[:-step] == rows.cell[step:]))
        if not len(i):
            break
        yield *pairs(i, i + step)[:2], none
    for head, end in zip(heads[~small].tolist(), ends[~small].tolist()):
        waits = most == 0 and rows.k[head] > 0
        kept, more, at = (none, none, none), waits, head + 1
        while at < end and not waits:
            upto = min(end, at + max(1, AT_ONCE // (end - head)))
            j, i = np.nonzero(np.arange(head, upto) < np.arange(at, upto)[:, None])
            i, j = i + head, j + at
            at, found = upto, pairs(i, j)
            if most is None:
                yield *found[:2], none
            elif len(found[0]):
                found = [np.concatenate(x) for x in zip(kept, found)]
                kept = nearest(*found)
                more |= len(kept[0]) < len(found[0])
                if len(kept[0]) > 8 * AT_ONCE:
                    yield *kept[:2], none
                    kept = none, none, none
        yield *kept[:2], np.arange(head, end) if more else none


def _left_out(members: DataFrame, least: float, most: int | None) -> DataFrame:
    """cell, k, a, b: near pairs of two roots, and with no a the members of cells that have more of them."""
    few = FEW

    def found(rows):
        for i, j, more in left_out(rows, least, few, most):
            x, y = rows.uid[i], rows.uid[j]
            a = np.concatenate((np.minimum(x, y), np.zeros(len(more), np.int64)))
            b = np.concatenate((np.maximum(x, y), rows.uid[more]))
            at = np.concatenate((j, more))
            a = pa.array(a, mask=np.arange(len(a)) >= len(i))
            columns = [pa.array(rows.cell[at]), pa.array(rows.k[at]), a, pa.array(b)]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "k", "a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            held = _Rows.of(batch) if held is None else held.then(_Rows.of(batch))
            last = int(np.searchsorted(held.cell, held.cell[-1], "left")) if len(held) else 0
            if last:
                yield from found(held.some(slice(0, last)))
                held = held.some(slice(last, None))
        if held is not None and len(held):
            yield from found(held)

    return _dealt(members).mapInArrow(run, "cell bigint, k int, a bigint, b bigint")


def _of_two_roots(members: DataFrame) -> DataFrame:
    """Members of cells that have more than one root."""
    cells = members.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y")
    return members.join(cells.select("cell"), "cell", "left_semi")


def _shingle_cells(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """cell, uid, root: cells that any two of the members share if they have a similarity of `least`.

    In the order of how many members hold them, two such sets share one of the first
    shingles of each: of `size` shingles, one more than may be missing in the other.
    """
    members = _small(write_once(members.select("uid", "root").distinct(), "crowded"))
    held = sets.join(members, "uid").select("uid", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("cell"))
    # What one member holds comes first and is a cell of one.
    shared = held.groupBy("cell").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    held = held.join(_small(write_once(shared, "shared")), "cell")
    held = held.withColumn("nth", F.row_number().over(Window.partitionBy("uid").orderBy("holders", "cell")))
    held = held.withColumn("nth", F.col("nth") + F.col("size") - F.count(F.lit(1)).over(Window.partitionBy("uid")))
    first = F.floor(F.lit(1 - least) * F.col("size") + F.lit(1e-9)) + 1
    return held.filter(F.col("nth") <= first).select("cell", "uid", "root")


def _in_parts(members: DataFrame) -> DataFrame:
    """cell, k, uid, root: cells of more than `MOST` members as cells of every part, and of every two."""
    counts = members.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(MOST)).cast("int").alias("parts"))
    members = members.join(counts, "cell")
    members = members.withColumn("own", F.pmod(F.xxhash64("uid", "cell"), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    k = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return members.select(F.when(F.col("parts") > 1, cell).otherwise(F.col("cell")).alias("cell"), k.alias("k"), "uid", "root")


def _all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members with their root: the least uid that links lead to."""
    stars = _small(components(links).select(F.col("a").alias("uid"), F.col("b").alias("star")))
    return members.join(stars, "uid", "left").withColumn("root", F.coalesce("star", "uid")).drop("star")


def similar_links(reps: DataFrame, texts: DataFrame, words: int = WORDS, least: float = SIMILAR) -> DataFrame:
    """a, b: links between similar texts, which connect those that share a cell.

    `reps` has uid and cells, one row for each different text; `texts` uid and text.
    """
    cells = reps.select("uid", F.explode("cells").alias("c")).select("uid", "c.cell")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    now = write_once(cells.join(sizes, "cell").select("cell", "uid", "n"), "cells")
    asked = _small(write_once(now.select("uid").distinct(), "asked"))
    sets = write_once(_sets(texts.join(asked, "uid", "left_semi"), words), "sets")
    marks = sets.select("uid", "fp", F.size("shingles").alias("size"))
    whole = now.withColumn("k", F.lit(0))
    met = write_once(_met(whole.withColumn("root", F.col("uid")).join(marks, "uid"), least), "met")
    judged = [write_once(_similar(met.filter("a is not null"), sets, least), "judged")]
    links = [judged[0].filter("same").select("a", "b")]
    rest = whole.join(met.filter("aside").select("cell").distinct(), "cell", "left_semi")
    rest = write_once(rest, "rest")
    if not rest.isEmpty():
        rest = write_once(_of_two_roots(_rooted(rest, links[0])), "rest")
        crowded = rest.filter(F.col("n") > MOST)
        if not crowded.isEmpty():
            finer = _of_two_roots(write_once(_shingle_cells(crowded, sets, least), "finer"))
            finer = _of_two_roots(_in_parts(finer))
            rest = write_once(rest.filter(F.col("n") <= MOST).drop("n").unionByName(finer), "rest")
    for most in ROUNDS:
        if rest.isEmpty():
            break
        met = write_once(_left_out(rest.join(marks, "uid"), least, most), "met")
        new = met.filter("a is not null").select("a", "b").distinct()
        new = new.join(_all_of(judged).select("a", "b"), ["a", "b"], "left_anti")
        judged.append(write_once(_similar(new, sets, least), "judged"))
        links.append(judged[-1].filter("same").select("a", "b"))
        rest = write_once(met.filter("a is null").select("cell", "k", F.col("b").alias("uid")), "rest")
        if not rest.isEmpty():
            rest = write_once(_of_two_roots(_rooted(rest, _all_of(links))), "rest")
    return _all_of(links)


def deduplicated(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    least: float = SIMILAR,
) -> DataFrame:
    """One row of each group of near-duplicates: the one with the least id, whole.

    Texts are linked if their sets of shingles of `words` words, A-Z in lower case,
    have a similarity of `least`, or if their words are the same; a group is what links
    connect. Texts of fewer words are one shingle, and texts without words, null
    ones among them, are one group. Null ids come last; of rows with the same id the
    first read stays. An empty table stays empty.
    """
    arrow_batches(documents.sparkSession)
    rows = packed(documents, text_col).withColumn("uid", F.monotonically_increasing_id())
    rows = write_once(rows, "similar-rows")
    asked = rows.select("uid", F.col("row")[id_col].alias("id"), "text")
    marked = write_once(_surveyed(asked, words), "survey")
    key = F.struct(F.col("id").isNull().alias("none"), "id", "uid")
    reps = marked.groupBy("d1", "d2").agg(
        F.min("uid").alias("uid"), F.min_by("cells", "uid").alias("cells"), F.min(key).alias("first")
    )
    reps = write_once(reps.select("uid", "cells", "first"), "different-texts")
    stars = components(similar_links(reps, asked.select("uid", "text"), words, least))
    stars = stars.select(F.col("a").alias("uid"), F.col("b").alias("star"))
    rooted = reps.select("uid", "first").join(stars, "uid", "left")
    keepers = rooted.groupBy(F.coalesce("star", "uid").alias("root")).agg(F.min("first").alias("first"))
    keepers = keepers.select("first.uid")
    gone = write_once(marked.select("uid").join(keepers, "uid", "left_anti"), "gone")
    return rows.join(_small(gone), "uid", "left_anti").select("row.*")
