"""Benchmark decontamination by Wu-Manber multi-pattern search.

Windows of ten consecutive benchmark words are the patterns. A window of the
text as long as the shortest pattern is looked at through its last block of
bytes: a table tells how far the search may move on, which is far where the block
is in no pattern. Where it may not move, the block selects patterns (by its
value, in a sorted array) and they are compared byte for byte. Short patterns
would spoil the shifts of long ones, so patterns are searched by classes of
length. Many positions of a batch move on side by side, each in a stretch of its
own, so a step is one vector operation.

Spark makes the windows of the benchmark distinct and numbers them; which items a
window is from is joined back to the few numbers that were found. One pass over
the documents searches about `PASS_BYTES` of distinct windows, which bounds what is
broadcast, however often a benchmark text repeats; more windows take more passes.
What is found depends on a text alone, so results of passes meet by the MD5 digest of
the text.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import arrow_batches, column, keyed, packed, text_slices, utf8, write_once

WINDOW = 10
PASS_BYTES = 32 << 20
STRETCH = 1024
# Least length in bytes of each class of patterns, and the block looked at.
CLASSES = ((24, 12), (8, 5), (2, 2), (1, 1))
_TABLE_BITS = 20
_SPACE, _END = 32, 1


def _byte_table() -> np.ndarray:
    """Word bytes as they are, A-Z in lower case, all others as a space."""
    out = np.full(256, _SPACE, np.uint8)
    for a, b, move in ((0x30, 0x3A, 0), (0x41, 0x5B, 32), (0x61, 0x7B, 0), (0x80, 0x100, 0)):
        out[a:b] = np.arange(a, b) + move
    return out


_BYTES = _byte_table()


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text."""
    data = text if isinstance(text, bytes) else (text or "").encode()
    return _BYTES[np.frombuffer(data, np.uint8)].tobytes().split(b" ") if data else []


def windows_of(text: str | bytes | None, size: int = WINDOW) -> list[tuple[bytes, int]]:
    """The windows of an item, as words joined by spaces, and how many words they have."""
    words = [w for w in words_of(text) if w]
    if not words:
        return []
    n = min(size, len(words))
    return [(b" ".join(words[i : i + n]), n) for i in range(len(words) - n + 1)]


class Patterns:
    """Tables for the windows of some items: (item id as a string or None, text)."""

    def __init__(self, items: list[tuple[str | None, str | bytes | None]], size: int = WINDOW):
        owners: dict[tuple[bytes, int], set] = defaultdict(set)
        for item, text in items:
            for window in windows_of(text, size):
                owners[window].add(item)
        found = sorted(owners)
        self.text = [w for w, _ in found]
        self.words = np.array([n for _, n in found], np.int64)
        self.items = [sorted(i for i in owners[w] if i is not None) for w in found]
        self.classes = []
        top = 1 << 62
        for least, block in CLASSES:
            ids = [i for i, w in enumerate(self.text) if least <= len(w) < top]
            top = least
            if ids:
                self.classes.append(self._tables(ids, block))

    def _tables(self, ids: list[int], block: int):
        """Shortest length, block, shift table, block values in order and their patterns."""
        m = min(len(self.text[i]) for i in ids)
        heads = np.frombuffer(b"".join(self.text[i][:m].rjust(m + 16, b"\1") for i in ids), np.uint8)
        heads = heads.reshape(len(ids), m + 16)
        shift = np.full(1 << _TABLE_BITS, m - block + 1, np.int32)
        for end in range(block, m + 1):
            at = heads[:, end : end + 16]
            key = _block(np.ascontiguousarray(at).view("<u8").reshape(-1, 2), block)
            np.minimum.at(shift, _slot(key), m - end)
        order = np.argsort(key, kind="stable")
        return m, block, shift, key[order], np.array(ids)[order]


def _block(last: np.ndarray, block: int) -> np.ndarray:
    """A number for the last `block` bytes of 16, given as two little-endian numbers."""
    if block <= 8:
        return last[:, 1] >> np.uint64(8 * (8 - block))
    high = last[:, 0] >> np.uint64(8 * (16 - block))
    return last[:, 1] * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)


def _slot(key: np.ndarray) -> np.ndarray:
    mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _search(text: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Where patterns begin and which; `text` has 16 spare bytes at both ends."""
    starts, which, data = [], [], text.tobytes()
    at8 = np.ndarray((len(text) - 7,), "<u8", data, strides=(1,))
    for m, block, shift, keys, ids in patterns.classes:
        first, last = 16 + m, len(text) - 16
        if first > last:
            continue
        at = np.arange(first, last + 1, STRETCH)
        stop = np.minimum(at + STRETCH, last + 1)
        stopped = []
        while len(at):
            if block <= 8:
                key = at8[at - 8] >> np.uint64(8 * (8 - block))
            else:
                key = _block(np.stack((at8[at - 16], at8[at - 8]), 1), block)
            move = shift[_slot(key)]
            still = move == 0
            if still.any():
                stopped.append(at[still])
            at = at + np.maximum(move, 1)
            going = at < stop
            if not going.all():
                at, stop = at[going], stop[going]
        if not stopped:
            continue
        ends = np.concatenate(stopped)
        key = _block(np.stack((at8[ends - 16], at8[ends - 8]), 1), block)
        low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        for k in np.flatnonzero(high > low):
            start = int(ends[k]) - m
            if text[start - 1] > _SPACE:
                continue
            for i in ids[low[k] : high[k]]:
                pattern = patterns.text[i]
                stop_at = start + len(pattern)
                if data[start:stop_at] == pattern and data[stop_at] <= _SPACE:
                    starts.append(start)
                    which.append(i)
    return np.array(starts, np.int64), np.array(which, np.int64)


def occurrences(texts: list[bytes], patterns: Patterns):
    """Per text: number of words, spans of hit words as (from, to), items found."""
    counts = np.zeros(len(texts), np.int64)
    spans: list[list] = [[] for _ in texts]
    items: list[list] = [[] for _ in texts]
    for a, b in text_slices(texts):
        raw = np.frombuffer(b"\1".join(texts[a:b]), np.uint8)
        sizes = np.fromiter(map(len, texts[a:b]), np.int64, b - a)
        norm = _BYTES[raw]
        norm[(np.cumsum(sizes + 1) - 1)[:-1]] = _END
        word = norm > _SPACE
        keep = word | (norm == _END)
        keep[1:] |= word[:-1]
        text = np.full(int(keep.sum()) + 32, _END, np.uint8)
        text[16:-16] = norm[keep]
        word = text > _SPACE
        begins = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        doc_ends = np.flatnonzero(text[16:-15] == _END) + 16
        doc_of = np.searchsorted(doc_ends, begins)
        counts[a:b] = np.bincount(doc_of, minlength=b - a)[: b - a]
        at, which = _search(text, patterns)
        if not len(at):
            continue
        low = np.searchsorted(begins, at)
        doc = doc_of[low]
        base = np.cumsum(counts[a:b]) - counts[a:b]
        low = low - base[doc]
        order = np.lexsort((low, doc))
        for k in order:
            i, p, n = a + int(doc[k]), int(low[k]), int(patterns.words[which[k]])
            if spans[i] and p <= spans[i][-1][1]:
                spans[i][-1][1] = max(spans[i][-1][1], p + n)
            else:
                spans[i].append([p, p + n])
        for i, w in set(zip((doc + a).tolist(), which.tolist())):
            items[i].extend(patterns.items[w])
    return counts, spans, items


def _windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (number, window), and which items have them (number, item). Written once."""
    rows = keyed(benchmark, id_col, text_col).select(F.col("id").cast("string").alias("item"), "text")

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                found = list({w for w, _ in windows_of(text, size)})
                for a in range(0, len(found), 10_000):
                    part = pa.array(found[a : a + 10_000], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(part), pa.string()), part], ["item", "window"]
                    )

    owned = write_once(rows.mapInArrow(run, "item string, window binary"), "benchmark-windows")
    number = F.monotonically_increasing_id().alias("number")
    windows = write_once(owned.select("window").distinct().select(number, "window"), "windows")
    return windows, owned.filter("item is not null").join(windows, "window").select("number", "item")


def _passes(windows: DataFrame, size: int, most: int):
    """Broadcast tables, each for about `most` bytes of distinct windows."""
    total = windows.agg(F.sum(F.octet_length("window"))).first()[0] or 0
    passes = max(1, -(-total // most))
    part = F.pmod(F.xxhash64("window"), F.lit(passes))
    for i in range(passes):
        found = windows.filter(part == i).collect()
        items = [(str(r["number"]), bytes(r["window"])) for r in found]
        yield windows.sparkSession.sparkContext.broadcast(Patterns(items, size))


_SPANS = "array<struct<a:int,b:int>>"


def _hit(rows: DataFrame, tables, only_hit: bool) -> DataFrame:
    """`rows` (id, text_key, text) with n_words, spans and numbers of windows."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        patterns = tables.value
        span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            counts, spans, items = occurrences(utf8(batch.column("text")), patterns)
            out = pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text_key"),
                    pa.array(counts),
                    pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], span),
                    pa.array([sorted(set(map(int, i))) for i in items], pa.list_(pa.int64())),
                ],
                ["id", "text_key", "n_words", "spans", "numbers"],
            )
            yield out.filter(pa.array([bool(s) for s in spans])) if only_hit else out

    schema = f"id {kind}, text_key binary, n_words bigint, spans {_SPANS}, numbers array<bigint>"
    return rows.mapInArrow(run, schema)


def _covered(spans: Column) -> Column:
    """Words in any of the spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("upto"))

    def step(state, span):
        more = F.greatest(F.lit(0), span["b"] - F.greatest(span["a"], state["upto"]))
        return F.struct(
            (state["n"] + more).alias("n"), F.greatest(state["upto"], span["b"]).alias("upto")
        )

    return F.aggregate(F.array_sort(spans), start, step, lambda state: state["n"])


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    size: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """id, n_words, spans of hit words, n_hit, items, for every row.

    Items are strings, sorted, each once; a null item id hits words but is in no
    list. Null and empty texts have no words. Repeated rows each get a row. An
    empty benchmark hits nothing; an empty table gives no rows.
    """
    arrow_batches(documents.sparkSession)
    rows = keyed(documents, id_col, text_col).withColumn("text_key", _text_key(F.col("text")))
    windows, owners = _windows(benchmark, item_col, "text", size)
    passes = _passes(windows, size, pass_bytes)
    first = write_once(_hit(rows, next(passes), only_hit=False), "words")
    found = ["text_key", "spans", "numbers"]
    hits = first.filter(F.size("spans") > 0).select(*found)
    for tables in passes:
        hits = hits.unionByName(_hit(rows, tables, only_hit=True).select(*found))
    # Equal texts have equal results, and one row for all of them.
    hits = hits.groupBy("text_key").agg(
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("numbers"))).alias("numbers"),
    )
    hits = write_once(hits, "hits")
    items = hits.select("text_key", F.explode("numbers").alias("number")).join(owners, "number")
    items = items.groupBy("text_key").agg(F.collect_set("item").alias("items"))
    hits = hits.drop("numbers").join(items, "text_key", "left")
    first = first.select("id", "text_key", "n_words").join(hits, "text_key", "left").select(
        "id",
        "n_words",
        F.coalesce("spans", F.array().cast(_SPANS)).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
    return first.select(
        "id",
        "n_words",
        F.array_sort("spans").alias("spans"),
        _covered(F.col("spans")).alias("n_hit"),
        F.array_sort("items").alias("items"),
    )


def decontaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    size: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """The rows of which no word is in an occurrence of a benchmark window, whole.

    Null and empty texts have no words and stay. Rows with null or repeated ids are
    judged each by its own text. An empty benchmark keeps all rows; an empty table
    stays empty. The corpus is filtered once, however many passes search it.
    """
    arrow_batches(documents.sparkSession)
    rows = packed(documents, text_col)
    passes = list(_passes(_windows(benchmark, item_col, "text", size)[0], size, pass_bytes))
    if len(passes) == 1:
        tables = passes[0]

        def run(batches):
            patterns = tables.value
            for batch in batches:
                _, spans, _ = occurrences(utf8(batch.column("text")), patterns)
                yield batch.filter(pa.array([not s for s in spans]))

        return rows.mapInArrow(run, rows.schema).select("row.*")
    keys = rows.withColumn("text_key", _text_key(F.col("text")))
    asked = keys.select(F.lit(0).alias("id"), "text_key", "text")
    hits = _hit(asked, passes[0], only_hit=True)
    for tables in passes[1:]:
        hits = hits.unionByName(_hit(asked, tables, only_hit=True))
    hits = write_once(hits.select("text_key").distinct(), "hits")
    return keys.join(hits, "text_key", "left_anti").select("row.*")


def _text_key(text: Column) -> Column:
    """The digest by which equal texts meet."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))
