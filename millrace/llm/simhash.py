"""SimHash near-duplicates by segment bit counts.

A fingerprint's 64 bits are cut into 32 segments, and it is embedded as the bit
counts of its segments. Each differing bit moves one count by at most one, so the
Manhattan distance of two embeddings is a lower bound of their Hamming distance.
The range join under that bound lays grids over groups of segments: where the
distance is at most three, at most three of six groups differ, so two embeddings
share the cell of some three groups. Within a cell rows are sorted by their total
bit count, the bound in one dimension. Those for which it differs by at most three
are compared by the Manhattan distance of their embeddings, and what is left is
verified on the fingerprints themselves.

Only distinct fingerprints are joined. A cell gives out a spanning forest of its
links, not all its pairs. A cell with more than `MOST` fingerprints is not
compared: its fingerprints go on to a finer grid, and in the last grid, where 52
bits are fixed, no cell can hold more than 4,096. So memory is bounded and no
link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import arrow_batches, keyed, packed, text_slices, utf8, write_once
from millrace.llm.links import components

DISTANCE = 3
WORDS = 3
SEED = 42
MOST = 4096
# Hashes whose bits are unpacked at once; words and hashes of a text are held whole.
HASHES_AT_ONCE = 1 << 16


def _hashes(text: bytes, words: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-words])).tolist()
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, (ends[words - 1 :] - 1).tolist())
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(starts))


def _set_bits(hashes: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """For each owner and bit, how many of its hashes have the bit set; owners are in order."""
    counts = np.zeros((owners, 64), np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        some, own = hashes[at : at + HASHES_AT_ONCE], owner[at : at + HASHES_AT_ONCE]
        bits = np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        counts[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    return counts


def fingerprints(texts: list[bytes], words: int = WORDS) -> np.ndarray:
    """The fingerprints, as int64, of some texts."""
    out = np.zeros(len(texts), np.int64)
    for a, b in text_slices(texts):
        hashes = [_hashes(t, words) for t in texts[a:b]]
        sizes = np.fromiter(map(len, hashes), np.int64, b - a)
        owner = np.repeat(np.arange(b - a), sizes)
        counts = _set_bits(np.concatenate(hashes), owner, b - a)
        over = np.packbits(counts * 2 > sizes[:, None], axis=1)
        out[a:b] = over.view(">u8").ravel().astype(np.uint64).view(np.int64)
    return out


def with_fingerprints(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """`rows` without their column `text`, with a bigint column `fp` in its place."""
    arrow_batches(rows.sparkSession)
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "fp bigint"])

    def run(batches):
        for batch in batches:
            fp = pa.array(fingerprints(utf8(batch.column("text")), words))
            rest = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*rest, fp], [*(f.name for f in kept), "fp"])

    return rows.mapInArrow(run, schema)


def _embedding(fp: Column) -> Column:
    """The bit counts of the 32 segments, two bits each, in one bigint."""
    even = F.lit(0x5555555555555555).cast("bigint")
    low, high = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    # The sum of two bits, as its two binary digits.
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def _masks(groups: int, same: int, width: int) -> list[int]:
    """Masks of every choice of `same` of `groups` groups of `width`-bit segments."""
    edges = np.linspace(0, 64 // width, groups + 1).round().astype(int) * width
    parts = [(1 << int(b)) - (1 << int(a)) for a, b in zip(edges, edges[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(parts, same)]


def _cells(fps: DataFrame, grid: int) -> DataFrame:
    """cell and fp, for every cell of the grid that a fingerprint is in."""
    value, masks = [
        (_embedding(F.col("fp")), _masks(6, 3, 2)),
        (F.col("fp"), _masks(8, 5, 1)),
        (F.col("fp"), _masks(16, 13, 1)),
    ][grid]
    keys = [
        F.xxhash64(F.lit(i), value.bitwiseAND(F.lit(m).cast("bigint"))) for i, m in enumerate(masks)
    ]
    return fps.select(F.explode(F.array(*keys)).alias("cell"), "fp")


def _steps(fp: np.ndarray) -> np.ndarray:
    """The embedding in unary: each segment's count as that many bits, from the right.

    The bits in which two differ are as many as the Manhattan distance of the embeddings.
    """
    even = np.uint64(0x5555555555555555)
    low, high = fp & even, fp >> np.uint64(1) & even
    return low | high | (low & high) << np.uint64(1)


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking rows i and j."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def _forest(cell: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, least row) that connect what is linked within cells; rows are sorted."""
    total = np.bitwise_count(fp.view(np.uint64)).astype(np.int16)
    steps = _steps(fp.view(np.uint64))
    label, at, step = np.arange(len(fp)), np.arange(len(fp)), 1
    while True:
        at = at[at + step < len(fp)]
        near = (cell[at] == cell[at + step]) & (total[at + step] - total[at] <= distance)
        at = at[near]
        if not len(at):
            break
        near = at[np.bitwise_count(steps[at] ^ steps[at + step]) <= distance]
        hit = near[np.bitwise_count((fp[near] ^ fp[near + step]).view(np.uint64)) <= distance]
        label = _united(label, hit, hit + step)
        step += 1
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return linked, label[linked]


def _compared(cells: DataFrame, distance: int, most: int) -> DataFrame:
    """a, b: links within cells; or a and no b: a fingerprint of a cell too large for a task."""

    def pairs(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a), b], ["a", "b"])

    def run(batches):
        cell, fp, large = np.empty(0, np.int64), np.empty(0, np.int64), None

        def done(upto):
            i, j = _forest(cell[:upto], fp[:upto], distance)
            return pairs(fp[i], pa.array(fp[j]))

        for batch in batches:
            new_cell, new_fp = (batch.column(c).to_numpy() for c in ("cell", "fp"))
            if large is not None:
                upto = np.searchsorted(new_cell, large, "right")
                yield pairs(new_fp[:upto], pa.nulls(int(upto), pa.int64()))
                new_cell, new_fp = new_cell[upto:], new_fp[upto:]
                if not len(new_cell):
                    continue
                large = None
            cell, fp = np.concatenate((cell, new_cell)), np.concatenate((fp, new_fp))
            heads = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            sizes = np.diff(np.append(heads, len(cell)))
            big = sizes > most
            if big.any():
                if big[-1]:
                    large = cell[-1]
                of = np.repeat(big, sizes)
                yield pairs(fp[of], pa.nulls(int(of.sum()), pa.int64()))
                cell, fp = cell[~of], fp[~of]
            last = 0
            if large is None and len(cell):
                last = len(cell) - np.searchsorted(cell, cell[-1], "left")
            yield done(len(cell) - last)
            cell, fp = cell[len(cell) - last :], fp[len(fp) - last :]
        yield done(len(cell))

    dealt = cells.repartition("cell").sortWithinPartitions("cell", F.bit_count("fp"))
    return dealt.mapInArrow(run, "a bigint, b bigint")


def linked(fps: DataFrame, distance: int = DISTANCE, most: int = MOST, grid: int = 0) -> DataFrame:
    """Links that connect all fingerprints (column `fp`, distinct) that differ in few bits."""
    if distance > DISTANCE:
        raise ValueError(f"the grids hold for a distance of {DISTANCE} bits at most")
    arrow_batches(fps.sparkSession, 100_000)
    found = None
    while True:
        limit = most if grid < 2 else MOST
        seen = write_once(_compared(_cells(fps, grid), distance, limit), "cells")
        links = seen.filter("b is not null")
        found = links if found is None else found.union(links)
        rest = seen.filter("b is null")
        if grid == 2 or rest.isEmpty():
            return found
        fps, grid = write_once(rest.select(F.col("a").alias("fp")).distinct(), "cells"), grid + 1


def classes(marked: DataFrame, least: Column, distance: int = DISTANCE) -> DataFrame:
    """fp and its component's least value, for every fingerprint of `marked`."""
    fps = write_once(marked.groupBy("fp").agg(F.min(least).alias("first")), "fingerprints")
    stars = components(linked(fps.select("fp"), distance))
    stars = stars.select(F.col("a").alias("fp"), F.col("b").alias("star"))
    rooted = fps.join(stars, "fp", "left")
    rooted = rooted.select("fp", "first", F.coalesce("star", "fp").alias("root"))
    least_of = rooted.groupBy("root").agg(F.min("first").alias("least"))
    return write_once(rooted.join(least_of, "root").select("fp", "least"), "classes")


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    distance: int = DISTANCE,
) -> DataFrame:
    """id, fp, component for every row.

    The component is the least id that can be reached over links, the row's own
    included; null ids are passed over, and a component of null ids has none. A
    null or empty text has fingerprint 0, which links like any other. Repeated
    rows each get a row. An empty table gives no rows.
    """
    rows = keyed(documents, id_col, text_col)
    marked = write_once(with_fingerprints(rows, words), "simhash")
    found = classes(marked, F.col("id"), distance)
    return marked.join(found, "fp").select("id", "fp", F.col("least").alias("component"))


def deduplicated(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: the one with the least id, whole.

    Null ids come last; of rows with the same id the first read stays.
    """
    rows = packed(documents, text_col).withColumn("uid", F.monotonically_increasing_id())
    marked = write_once(
        with_fingerprints(rows.select("uid", "row", "text")), "simhash-rows"
    )
    key = F.struct(F.col("row")[id_col].isNull().alias("none"), F.col("row")[id_col].alias("id"), "uid")
    keepers = classes(marked.select("uid", "fp", "row"), key).select("least.uid").distinct()
    return marked.join(keepers, "uid", "left_semi").select("row.*")
