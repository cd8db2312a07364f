"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table projects vectors on random Gaussian directions, adds a random shift and
cuts the line in cells; a vector's bucket is its cells in all directions. The
difference of two vectors at distance r is spread normally, with deviation r, on
each direction, so the chance that a neighbour at that distance lies in a given
bucket is a product of normal probabilities. A query visits buckets in the order
of that chance until their sum reaches its share of the wanted recall, in each
table. Candidates of all tables are merged and ranked by their exact distance.
A query that found fewer than asked, or whose last is farther than r, is compared
with every vector instead, so that the recall holds for outliers as well.

The distance r at which neighbours are expected, and from it the width of a cell,
is taken from a sample of at most about `SAMPLE` vectors. Every vector is indexed.

Buckets are dealt over slots, large ones in several pieces, so that a task gets a
bounded number of vectors at a time and keeps only the nearest few of each query.
The queries of a slot are dealt over blocks, which each meet the slot's vectors.
Equal vectors are indexed once, with their smallest ids.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.common import arrow_batches, column, write_once

NEAREST = 10
TABLES, DIRECTIONS, WIDTH = 2, 8, 2.5
RECALL = 0.975
SAMPLE = 2000
SLOT_ROWS = 20_000
# Queries of a block, and the buckets they visit: about so many at most.
QUERY_ROWS, VISITS = 4096, 1 << 21
SEED = 11
# Buckets of one query and table that are looked at; what the normal law leaves
# beyond them is far below what the wanted recall leaves out.
BEAM = 1 << 16
_U = np.uint64
_PARTS = 1 << 20
_BLOCK = 4_000_000


@dataclass
class Index:
    """Directions, shifts and factors of the tables, and the distance they are made for."""

    axes: np.ndarray
    shift: np.ndarray
    factor: np.ndarray
    width: float
    distance: float
    share: float

    def _lines(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.axes[table] / self.width + self.shift[table]

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        """The bucket of each vector, as one number."""
        cells = np.floor(self._lines(x, table)).astype(np.int64).view(_U)
        return (cells * self.factor[table]).sum(axis=1, dtype=_U) + _U(table)

    def probes(self, x: np.ndarray, table: int) -> np.ndarray:
        """The buckets that one vector visits, likeliest first."""
        line = self._lines(x[None], table)[0]
        chance, bucket = np.ones(1), np.full(1, table, _U)
        for i, at in enumerate(line):
            reach = math.ceil(4.5 * self.distance / self.width) + 1
            cells = np.arange(math.floor(at) - reach, math.floor(at) + reach + 1)
            scale = self.width / self.distance / math.sqrt(2)
            edge = [0.5 * math.erf((c - at) * scale) for c in [*cells, cells[-1] + 1]]
            one = np.diff(edge)
            chance = np.outer(chance, one).ravel()
            bucket = np.add.outer(bucket, cells.view(_U) * self.factor[table, i]).ravel()
            keep = np.flatnonzero(chance > 1e-9)
            if len(keep) > BEAM:
                keep = keep[np.argpartition(-chance[keep], BEAM)[:BEAM]]
            chance, bucket = chance[keep], bucket[keep]
        order = np.argsort(-chance, kind="stable")
        enough = int(np.searchsorted(np.cumsum(chance[order]), self.share)) + 1
        return bucket[order[:enough]]


def _matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.empty((0, 0))


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles): without nulls, zero vectors, and null or non-finite components.

    Rows with a null id take no part either, nor do vectors whose length is not
    the commonest (the smaller of two that are equally common).
    """
    x = column(vectors, vector_col).cast("array<double>")
    rows = vectors.select(column(vectors, id_col).cast("bigint").alias("id"), x.alias("vector"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = rows.filter("id is not null and vector is not null")
    rows = rows.filter(~F.exists("vector", bad) & F.exists("vector", lambda v: v != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    top = sizes.orderBy(F.desc("rows"), "n").first()
    return rows.filter(F.size("vector") == (top["n"] if top else 0))


def fitted(rows: DataFrame, nearest: int, recall: float, tables: int, directions: int) -> Index | None:
    """An index for the rows; None if there are fewer than two."""
    n = rows.count()
    if n < 2:
        return None
    share = min(1.0, 0.95 * SAMPLE / n)
    drawn = F.pmod(F.xxhash64("id"), F.lit(_PARTS)) < int(share * _PARTS) + (share == 1.0)
    some = np.array(sorted((r["id"], r["vector"]) for r in rows.filter(drawn).collect()), object)
    some = np.array([r[1] for r in some], float)
    distance = 0.0
    if len(some) > 1:
        square = (some**2).sum(1)
        apart = np.sqrt(np.maximum(square[:, None] + square - 2 * some @ some.T, 0))
        np.fill_diagonal(apart, np.inf)
        # What most vectors need; not a mean over pairs, which a dense cluster would rule.
        rank = min(len(some) - 1, max(1, math.ceil(nearest * len(some) / n)))
        distance = float(np.quantile(np.partition(apart, rank - 1, axis=1)[:, rank - 1], 0.9))
    if distance < 1e-9:
        distance = float(np.linalg.norm(some[0])) if len(some) else 1.0
    rng = np.random.default_rng(SEED)
    size = len(some[0]) if len(some) else len(rows.first()["vector"])
    return Index(
        rng.standard_normal((tables, size, directions)),
        rng.uniform(0, 1, (tables, directions)),
        rng.integers(0, 1 << 63, (tables, directions), dtype=np.int64).view(_U) * _U(2) + _U(1),
        WIDTH * distance,
        distance,
        1 - (1 - recall) ** (1 / tables),
    )


def _bucketed(rows: DataFrame, index, tables: int) -> DataFrame:
    """table, bucket, id, vector, ids: a row for each vector and table."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("vector"))
            for t in range(tables if len(x) else 0):
                bucket = pa.array(index.value.buckets(x, t).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t, np.int32)), bucket, *(batch.column(c) for c in ("id", "vector", "ids"))],
                    ["table", "bucket", "id", "vector", "ids"],
                )

    schema = "table int, bucket bigint, id bigint, vector array<double>, ids array<bigint>"
    return rows.mapInArrow(run, schema)


def _probed(queries: DataFrame, index, tables: int) -> DataFrame:
    """id and bucket: what each query visits."""

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("vector"))
            for qid, row in zip(batch.column("id").to_pylist(), x):
                for t in range(tables):
                    bucket = index.value.probes(row, t).view(np.int64)
                    ids = pa.array(np.full(len(bucket), qid, np.int64))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(bucket)], ["id", "bucket"])

    return queries.mapInArrow(run, "id bigint, bucket bigint")


class _Nearest:
    """The nearest `keep` vectors of each query of a slot, by distance and then by id."""

    def __init__(self, ids, x, buckets, keep: int):
        self.ids, self.x, self.keep = ids, x, keep
        self.best: list[list] = [[] for _ in ids]
        query = np.repeat(np.arange(len(ids)), np.concatenate([n for _, n in buckets]))
        bucket = np.concatenate([b for b, _ in buckets])
        order = np.argsort(bucket, kind="stable")
        self.bucket, self.query = bucket[order], query[order]

    def add(self, bucket, ids, x, members):
        order = np.argsort(bucket, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
        for a, b in zip(heads, np.append(heads[1:], len(order))):
            rows = order[a:b]
            low, high = (np.searchsorted(self.bucket, bucket[rows[0]], s) for s in ("left", "right"))
            mine = np.unique(self.query[low:high])
            step = max(1, _BLOCK // (len(rows) * x.shape[1]))
            for c in range(0, len(mine), step):
                some = mine[c : c + step]
                gap = self.x[some][:, None, :] - x[rows][None]
                far = np.sqrt((gap * gap).sum(-1))
                for q, d in zip(some, far):
                    take = np.arange(len(d))
                    if len(d) > self.keep:
                        take = np.flatnonzero(d <= np.partition(d, self.keep - 1)[self.keep - 1])
                    best = self.best[q]
                    best += [(float(d[i]), int(ids[rows[i]]), members[rows[i]]) for i in take]
                    if len(best) > 8 * self.keep:
                        self.best[q] = self._trimmed(best)

    def _trimmed(self, best):
        """The nearest, each once: a vector may come from the buckets of several tables."""
        return sorted({r[1]: r for r in best}.values(), key=lambda r: r[:2])[: self.keep]

    def rows(self):
        found = []
        for qid, best in zip(self.ids, self.best):
            for d, _, members in self._trimmed(best):
                found += [(qid, m, d) for m in members]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))],
            ["query", "id", "distance"],
        )


def _searched(rows: DataFrame, keep: int) -> DataFrame:
    """query, id, distance: the nearest in each slot; a slot's queries come before its vectors."""

    def run(batches):
        slot, queries, state = None, [], None
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            heads = np.flatnonzero(np.concatenate(([True], np.diff(slots) != 0)))
            for a, b in zip(heads, np.append(heads[1:], len(slots))):
                if slots[a] != slot:
                    if state is not None:
                        yield state.rows()
                    slot, queries, state = slots[a], [], None
                part = batch.slice(a, b - a)
                split = int(np.searchsorted(part.column("kind").to_numpy(), 1))
                if split:
                    ask = part.slice(0, split)
                    own = ask.column("ids")
                    own = own.flatten().to_numpy(), pc.list_value_length(own).to_numpy()
                    queries.append((ask.column("id").to_pylist(), _matrix(ask.column("vector")), own))
                if split < b - a and queries:
                    if state is None:
                        ids = [i for q in queries for i in q[0]]
                        state = _Nearest(ids, np.concatenate([q[1] for q in queries]), [q[2] for q in queries], keep)
                    have = part.slice(split)
                    state.add(
                        have.column("bucket").to_numpy(),
                        have.column("id").to_numpy(),
                        _matrix(have.column("vector")),
                        have.column("ids").to_pylist(),
                    )
        if state is not None:
            yield state.rows()

    dealt = rows.repartition("slot").sortWithinPartitions("slot", "kind")
    return dealt.mapInArrow(run, "query bigint, id bigint, distance double")


def _compared(vectors: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """query, id, distance: the nearest of all vectors, in blocks of both sides."""
    pieces = max(1, -(-vectors.count() // SLOT_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    nought = F.lit(0).cast("bigint")
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    each = lambda n: F.explode(F.sequence(nought, F.lit(n - 1).cast("bigint")))
    have = vectors.select("*", part(pieces).alias("piece"), each(blocks).alias("block"))
    ask = queries.select("*", part(blocks).alias("block"), each(pieces).alias("piece"))
    slot = (F.col("piece") * blocks + F.col("block")).alias("slot")
    # One bucket for all.
    have = have.select(slot, F.lit(1).alias("kind"), nought.alias("bucket"), "id", "vector", "ids")
    ask = ask.select(slot, F.lit(0).alias("kind"), nought.alias("bucket"), "id", "vector", F.array(nought).alias("ids"))
    return _searched(have.unionByName(ask), keep)


def _ranked(found: DataFrame, nearest: int) -> DataFrame:
    """query, rank, id, distance: the nearest but the query itself."""
    order = Window.partitionBy("query").orderBy("distance", "id")
    ranked = found.filter("query != id").distinct().withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= nearest).select("query", "rank", "id", "distance")


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    nearest: int = NEAREST,
    recall: float = RECALL,
    tables: int = TABLES,
    directions: int = DIRECTIONS,
) -> DataFrame:
    """query, rank from 1, id, distance: for each query its nearest vectors but itself.

    Distances are Euclidean, exact, in double precision; ties go to the smaller
    id. What takes part: see `clean`. A vector repeated with its id counts once.
    A query with fewer candidates than asked gets those, all of them; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 4000)
    rows = write_once(clean(vectors, id_col, vector_col).distinct(), "vectors")
    asked = queries.select(column(queries, id_col).cast("bigint").alias("id")).distinct()
    index = fitted(rows, nearest, recall, tables, directions)
    if index is None:
        none = "query bigint, rank int, id bigint, distance double"
        return spark.createDataFrame([], none)
    sent = spark.sparkContext.broadcast(index)
    # Of equal vectors, the ids that can be among the nearest of any query.
    nth = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= nearest + 1)
    kept = few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    kept = kept.select(F.col("ids")[0].alias("id"), "vector", "ids")
    stored = write_once(_bucketed(kept, sent, tables), "buckets")
    asking = write_once(rows.join(asked, "id"), "queries")
    visits = _probed(asking, sent, tables)
    large = stored.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / SLOT_ROWS).alias("pieces"))
    large = write_once(large.filter("pieces > 1"), "large-buckets")
    slots = max(1, -(-stored.count() // SLOT_ROWS))
    slot = lambda piece: F.pmod(F.xxhash64("bucket", piece), F.lit(slots)).alias("slot")
    pieces = F.coalesce("pieces", F.lit(1))
    have = stored.join(large, "bucket", "left")
    have = have.select(
        slot(F.pmod(F.xxhash64("id"), pieces)), F.lit(1).alias("kind"), "bucket", "id", "vector", "ids"
    )
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), pieces - 1)).alias("piece")
    ask = visits.join(large, "bucket", "left").select("id", "bucket", every)
    ask = ask.select("id", "bucket", slot(F.col("piece"))).groupBy("slot", "id")
    ask = write_once(ask.agg(F.collect_set("bucket").alias("ids")), "visits")
    blocks = F.greatest(
        F.ceil(F.count(F.lit(1)) / QUERY_ROWS), F.ceil(F.sum(F.size("ids")) / VISITS)
    )
    blocks = write_once(ask.groupBy("slot").agg(blocks.alias("blocks")), "blocks")
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    block = lambda place: (F.col("slot") * most + place).alias("slot")
    ask = ask.join(blocks, "slot").join(asking, "id").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    ask = ask.select(block(F.col("block")), "id", "vector", "ids")
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block")
    have = have.join(blocks, "slot").select("*", each)
    have = have.select(block(F.col("block")), "kind", "bucket", "id", "vector", "ids")
    ask = ask.select(
        "slot", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("bucket"), "id", "vector", "ids"
    )
    found = _ranked(_searched(have.unionByName(ask), nearest + 1), nearest)
    found = write_once(found, "nearest")
    # Up to the distance that the probes are made for, each neighbour is found with the wanted recall.
    sure = found.filter((F.col("rank") == nearest) & (F.col("distance") <= index.distance)).select("query")
    unsure = write_once(asking.join(sure, asking["id"] == sure["query"], "left_anti"), "queries")
    if unsure.isEmpty():
        return found
    every = stored.filter(F.col("table") == 0).select("id", "vector", "ids")
    exact = _ranked(_compared(every, unsure, nearest + 1), nearest)
    return found.join(sure, "query", "left_semi").unionByName(exact)
