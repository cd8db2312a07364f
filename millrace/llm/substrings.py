"""Removal of long repeats by recompression.

Words are named by hash, and rounds of recompression rename them: a run of one
symbol becomes a symbol named by it and the run's length; then symbols are put on
two sides by a bit of their name, and every left one that a right one follows
becomes a pair, named by both. A name depends on its contents alone, so it is the
same in every document and task without an exchange of dictionaries, and whether
two neighbours join depends only on them. Equal word sequences therefore get
equal symbols, but for a few at either end that their surroundings may change.

Each window of fifty words has an anchor: the least name among triples of those
of its symbols that no surroundings can change, in the last round that leaves any.
Equal windows have equal anchors. Spark first counts in which documents anchors
occur; windows whose anchor is in one document only are done. The others are
verified: their 128-bit fingerprints are grouped to find the least document.

Copies of a whole document are settled by a fingerprint of its words beforehand.
Rows with one id are told apart by the MD5 digest of their texts. So what is removed
is exactly what repeats, unless two different words, windows, or texts of one id have
the same 128 bits: for each such pair a chance in the order of 2^-128, if their
makers did not aim at it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.common import arrow_batches, column, packed, text_slices, utf8, write_once

WINDOW = 50
ROUNDS = 4
GRAM = 3
# Per-document results are broadcast up to so many numbers (8 bytes each), and
# joined by a shuffle beyond.
BROADCAST_NUMBERS = 2_000_000

_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
# Odd factors of the two window fingerprints.
_FACTORS = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _C2
    x = (x ^ (x >> _U(27))) * _C3
    return x ^ (x >> _U(31))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for a followed by b."""
    return _mixed(_mixed(a + _C1) * _U(3) + b)


def split_words(text: bytes) -> list[bytes]:
    return text.split()


class _Words:
    """The words of some texts: two 64-bit names each, and where texts begin."""

    def __init__(self, words: list[list[bytes]]):
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        digest = xxhash.xxh3_128_digest
        names = np.frombuffer(b"".join(digest(w) for x in words for w in x), "<u8").reshape(-1, 2)
        self.names, self.other = np.ascontiguousarray(names[:, 0]), names[:, 1]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first = np.zeros(len(names), bool)
        self.first[self.starts[self.sizes > 0]] = True

    def windows(self, size: int) -> np.ndarray:
        """Where windows that lie in one text begin."""
        ends = self.starts + np.maximum(self.sizes - size + 1, 0)
        edge = np.zeros(len(self.names) + 1, np.int32)
        np.add.at(edge, self.starts, 1)
        np.add.at(edge, ends, -1)
        return np.flatnonzero(np.cumsum(edge)[:-1] > 0)


def _round(names: np.ndarray, first: np.ndarray, turn: int):
    """One round: run of each symbol, side of each run, unit of each run, new names, new first."""
    head = np.ones(len(names), bool)
    head[1:] = (names[1:] != names[:-1]) | first[1:]
    run_of = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, len(names))).astype(_U)
    runs, run_first = names[at], first[at]
    long = length > 1
    runs[long] = _joined(runs[long], length[long])
    side = _mixed(runs + _C1 * np.array([turn + 1], _U)) >> _U(63) == 1
    second = np.zeros(len(runs), bool)
    second[1:] = side[1:] & ~side[:-1] & ~run_first[1:]
    unit_of = np.cumsum(~second) - 1
    heads = np.flatnonzero(~second)
    units = runs[heads]
    paired = np.flatnonzero(second)
    units[unit_of[paired]] = _joined(runs[paired - 1], runs[paired])
    return run_of, side, unit_of, units, run_first[heads]


def _least(values: np.ndarray, low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Least of values[low : low + count], for each low; counts are positive and small."""
    out = np.empty(len(low), _U)
    power, span = values, 1
    while True:
        here = (count >= span) & (count < 2 * span)
        if here.any():
            a = low[here]
            out[here] = np.minimum(power[a], power[a + count[here] - span])
        if not (count >= 2 * span).any():
            return out
        power = np.minimum(power[:-span], power[span:])
        span *= 2


def anchors(words: _Words, at: np.ndarray, size: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """The anchor of each window that begins at one of `at`."""
    out = np.empty(len(at), _U)
    names, first = words.names, words.first
    left, low, high = np.arange(len(at)), at, at + size

    def settle(which, turn):
        count = high[which] - low[which]
        for gram in range(1, GRAM + 1):
            mine = which[np.minimum(count, GRAM) == gram]
            if len(mine):
                grams = names[: len(names) - gram + 1]
                for i in range(1, gram):
                    grams = _joined(grams, names[i : len(names) - gram + 1 + i])
                found = _least(grams, low[mine], high[mine] - low[mine] - gram + 1)
                out[left[mine]] = _joined(found, np.full(len(mine), turn * 8 + gram, _U))

    for turn in range(rounds):
        run_of, side, unit_of, units, unit_first = _round(names, first, turn)
        # The runs at both ends may go on outside; then a right symbol may have its
        # partner outside on the left, and a left one on the right.
        a, b = run_of[low] + 1, run_of[high - 1]
        some = a < b
        a = np.where(some, a, 0)
        b = np.where(some, b, 1)
        a2, b2 = a + side[a], b - ~side[b - 1]
        some &= a2 < b2
        gone = np.flatnonzero(~some)
        if len(gone):
            settle(gone, turn)
        stay = np.flatnonzero(some)
        left, low, high = left[stay], unit_of[a2[stay]], unit_of[b2[stay] - 1] + 1
        names, first = units, unit_first
        if not len(left):
            return out
    settle(np.arange(len(left)), rounds)
    return out


def _prints(names: np.ndarray, at: np.ndarray, size: int, factor: int) -> np.ndarray:
    """Fingerprints of the windows at `at`: polynomials in `factor`, modulo 2^64."""
    powers = np.cumprod(np.full(len(names), factor, _U))
    back = np.cumprod(np.full(len(names), pow(factor, -1, 1 << 64), _U))
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(names * powers)))
    return (sums[at + size] - sums[at]) * back[at]


def _parsed(batch, rows=None):
    """Slices of a batch: row range and its words."""
    texts = utf8(batch.column("text"))
    for a, b in text_slices(texts):
        yield a, b, [split_words(t) for t in texts[a:b]]


def _surveyed(rows: DataFrame, size: int) -> DataFrame:
    """id, text_key, n_words, a fingerprint of all words, the text's anchors, and a number of the row."""

    def run(batches):
        for batch in batches:
            for a, b, lists in _parsed(batch):
                words = _Words(lists)
                at = words.windows(size)
                found = anchors(words, at, size)
                new = np.ones(len(at), bool)
                doc = np.searchsorted(words.starts, at, "right") - 1
                # Empty texts share their start with the next; the last such text has the words.
                new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
                found, doc = found[new], doc[new]
                edges = np.searchsorted(doc, np.arange(b - a + 1))
                whole = b"".join(xxhash.xxh3_128_digest(b" ".join(x)) for x in lists)
                whole = np.frombuffer(whole, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a),
                        batch.column("text_key").slice(a, b - a),
                        pa.array(words.sizes),
                        pa.array(whole[:, 0]),
                        pa.array(whole[:, 1]),
                        pa.ListArray.from_arrays(
                            pa.array(edges, pa.int32()), pa.array(found.view(np.int64))
                        ),
                    ],
                    ["id", "text_key", "n_words", "whole", "whole2", "anchors"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(
        run,
        f"id {kind}, text_key binary, n_words bigint, whole bigint, whole2 bigint, anchors array<bigint>",
    )
    return found.withColumn("uid", F.monotonically_increasing_id())


def _candidates(rows: DataFrame, size: int) -> DataFrame:
    """print1, print2, id, uid, at: the windows whose anchor is in the row's list `shared`."""

    def run(batches):
        for batch in batches:
            shared = batch.column("shared")
            for a, b, lists in _parsed(batch):
                words = _Words(lists)
                at = words.windows(size)
                found = anchors(words, at, size).view(np.int64)
                doc = np.searchsorted(words.starts, at, "right") - 1
                mine = shared.slice(a, b - a)
                values = mine.flatten().to_numpy()
                owner = np.repeat(np.arange(b - a), np.diff(mine.offsets.to_numpy()))
                # An anchor is looked up together with its row.
                mark = _joined(values.view(_U), owner.astype(_U))
                hit = np.isin(_joined(found.view(_U), doc.astype(_U)), mark)
                at, doc = at[hit], doc[hit]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_prints(words.names, at, size, _FACTORS[0]).view(np.int64)),
                        pa.array(_prints(words.other, at, size, _FACTORS[1]).view(np.int64)),
                        batch.column("id").take(pa.array(doc + a)),
                        batch.column("uid").take(pa.array(doc + a)),
                        pa.array((at - words.starts[doc]).astype(np.int32)),
                    ],
                    ["print1", "print2", "id", "uid", "at"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"print1 bigint, print2 bigint, id {kind}, uid bigint, at int")


def _small(df: DataFrame, numbers: str) -> DataFrame:
    """`df`, marked to be broadcast if it holds few enough numbers."""
    total = df.agg(F.coalesce(F.sum(F.size(numbers) + 5), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_NUMBERS else df


def _repeats(rows: DataFrame, size: int) -> DataFrame:
    """id, text_key, copy, spans: rows that lose words, and which; spans are (from, to)."""
    survey = write_once(_surveyed(rows, size), "survey").filter("id is not null")
    wholes = survey.filter(F.col("n_words") >= size).select("id", "text_key", "whole", "whole2")
    least = wholes.groupBy("whole", "whole2").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    least = write_once(least.filter("least < most").drop("most"), "copied")
    copies = wholes.join(least, ["whole", "whole2"]).filter("id > least").select("id", "text_key")
    copies = write_once(copies.distinct(), "copies")
    kept = survey.join(copies, ["id", "text_key"], "left_anti")
    anchor = kept.select("id", "uid", F.explode(F.array_distinct("anchors")).alias("anchor"))
    shared = anchor.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    shared = write_once(shared.filter("least < most").select("anchor"), "shared")
    lists = anchor.join(shared, "anchor").groupBy("uid").agg(F.collect_set("anchor").alias("shared"))
    # Rows with the same id and text have the same list: the first stands for all.
    lists = lists.join(survey.select("uid", "id", "text_key"), "uid").groupBy("id", "text_key")
    lists = write_once(lists.agg(F.min("uid").alias("uid"), F.min_by("shared", "uid").alias("shared")), "shared-lists")
    texts = rows.join(_small(lists, "shared"), ["id", "text_key"])
    found = write_once(_candidates(texts, size), "windows")
    first = found.groupBy("print1", "print2").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    first = write_once(first.filter("least < most").drop("most"), "repeated")
    again = found.join(first, ["print1", "print2"]).filter("id > least").select("uid", "at").distinct()
    order = Window.partitionBy("uid").orderBy("at")
    gap = F.coalesce(F.col("at") - F.lag("at").over(order) > size, F.lit(True))
    again = again.withColumn("span", F.sum(gap.cast("int")).over(order))
    spans = again.groupBy("uid", "span").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    spans = spans.groupBy("uid").agg(
        F.collect_list(F.struct("a", (F.col("b") + size).alias("b"))).alias("spans")
    )
    spans = spans.join(lists.drop("shared"), "uid")
    whole = copies.select("id", "text_key", F.lit(True).alias("copy"), F.lit(None).alias("spans"))
    parts = spans.select("id", "text_key", F.lit(False).alias("copy"), "spans")
    return write_once(parts.unionByName(whole), "spans")


def _cut(lists: list[list[bytes]], copies: list, spans: list) -> list[list[bytes]]:
    """The words that stay."""
    out = []
    for words, copy, cuts in zip(lists, copies, spans):
        if copy:
            words = []
        elif cuts:
            stays = np.ones(len(words), bool)
            for cut in cuts:
                stays[cut["a"] : cut["b"]] = False
            words = [words[i] for i in np.flatnonzero(stays)]
        out.append(words)
    return out


def _text_key(text_col):
    """Tells texts of rows with the same id apart."""
    return F.unhex(F.md5(F.coalesce(text_col, F.lit(""))))


def without_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW
) -> DataFrame:
    """id, n_words, n_removed, kept, for every row: kept is the words that stay, joined by a space.

    A word goes if a window of `size` words covers it whose words also begin
    somewhere in a row with a smaller id. Null and empty texts have no words. A
    null id is neither smaller nor larger than any. Rows with the same id do
    not count against each other. An empty table gives no rows.
    """
    marked = _marked(documents, id_col, text_col, size).drop("row")

    def run(batches):
        for batch in batches:
            copies, spans = batch.column("copy").to_pylist(), batch.column("spans").to_pylist()
            for a, b, lists in _parsed(batch):
                kept = _cut(lists, copies[a:b], spans[a:b])
                sizes, stay = [len(x) for x in lists], [len(x) for x in kept]
                joined = [b" ".join(x) for x in kept]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a),
                        pa.array(sizes, pa.int64()),
                        pa.array([x - y for x, y in zip(sizes, stay)], pa.int64()),
                        pa.array(joined, pa.binary()).cast(pa.string()),
                    ],
                    ["id", "n_words", "n_removed", "kept"],
                )

    kind = marked.schema["id"].dataType.simpleString()
    return marked.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept string")


def _marked(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """row, id, text, text_key, copy, spans for every row."""
    arrow_batches(documents.sparkSession)
    rows = packed(documents, text_col).withColumn("id", F.col("row").getField(id_col))
    rows = rows.withColumn("text_key", _text_key(F.col("text")))
    repeats = _repeats(rows.select("id", "text_key", "text"), size)
    return rows.join(_small(repeats, "spans"), ["id", "text_key"], "left")


def repeats_removed(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW
) -> DataFrame:
    """The rows with repeated words cut out of the text.

    A text of which nothing is cut stays as it is; of others the words that stay
    are joined by a space, and a row of which none stays goes. A column n_chars,
    if there is one, follows the text.
    """
    marked = _marked(documents, id_col, text_col, size)
    whole = marked.filter("copy is null").select("row.*")
    hit = marked.filter("not copy").select("row", "text", "copy", "spans")

    def run(batches):
        for batch in batches:
            copies, spans = batch.column("copy").to_pylist(), batch.column("spans").to_pylist()
            for a, b, lists in _parsed(batch):
                joined = [b" ".join(x) for x in _cut(lists, copies[a:b], spans[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(a, b - a), pa.array(joined, pa.binary()).cast(pa.string())],
                    ["row", "text"],
                )

    schema = f"row {marked.schema['row'].dataType.simpleString()}, text string"
    left = hit.mapInArrow(run, schema).filter("text != ''")
    fields = [
        F.col("text").alias(f) if f == text_col
        else F.length("text").cast("bigint").alias(f) if f == "n_chars"
        else F.col("row").getField(f).alias(f)
        for f in documents.columns
    ]
    return whole.unionByName(left.select(*fields))
