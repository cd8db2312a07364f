"""Packing token sequences by harmonic classes.

A piece of length s, of a sequence of capacity C, is in class k = C // s: k of its
kind fit. Each class fills its own sequences with exactly k pieces, so a piece's
place follows from its number in its class alone: tasks count their pieces per
class, offsets are added up over the small table of counts, and no task waits for
another. Pieces of a class leave C / k - s tokens of their share empty; a document
is cut where that would be much: into whole sequences first, then, while the
rest wastes more than `WASTE` tokens, at the bound of the next class below it.

What is left of each class, fewer than k pieces, is bounded by a constant whatever
the data (about 10,000 pieces in all) and is packed by first fit, longest first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from itertools import chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.common import arrow_batches, keyed, text_slices, write_once

CAPACITY = 2048
WASTE = 8
END_ID = 1
# Entries a task keeps of words it has encoded; beyond that it goes back to those it
# met first, which are the commonest. So do the next tasks of its process.
KNOWN_WORDS = 300_000
KEPT_WORDS = 150_000
# Fixed value: how a byte-level tokenizer cuts a text into words.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts without the signs of `_ODD`, in which Python's own classes
# mean the same; its expressions are faster.
_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
_ODD = re.compile("[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be]|[^\x00-\u024f]")
# New words are encoded so many in one text, where they part again, and so many at
# once, as what the tokenizer returns takes some hundred bytes a token.
_TOGETHER = 256
_AT_ONCE = 4096


def cuts(length: int, capacity: int = CAPACITY, waste: int = WASTE) -> list[int]:
    """Lengths of the pieces of a document, in order."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        bound = capacity // (k + 1)
        if capacity / k - rest <= waste or bound == 0:
            return [*out, rest]
        out.append(bound)
        rest -= bound
    return out


class Encoder:
    """Ids of texts by a tokenizer of the library `tokenizers`, as little-endian 32-bit bytes.

    A byte-level tokenizer encodes each word by itself, so words are encoded once
    and looked up; any other tokenizer gets whole texts. Special tokens' strings
    are ordinary text.
    """

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True
        parts = json.loads(spec)
        pre = parts.get("pre_tokenizer") or {}
        by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        by_word = by_word and not pre.get("add_prefix_space") and not parts.get("normalizer")
        self.by_word = by_word
        self.plain, self.full = re.compile(_PLAIN).findall, regex.compile(BYTE_LEVEL).findall
        self.known: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [_packed_ids(x.ids) for x in found]

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), _AT_ONCE):
            self._learn_some(words[i : i + _AT_ONCE])

    def _learn_some(self, words: list[str]) -> None:
        # A space before something else always begins a word, so such words can
        # stand in one text.
        spaced = [w for w in words if w[0] == " " and not w.isspace()]
        groups = [spaced[i : i + _TOGETHER] for i in range(0, len(spaced), _TOGETHER)]
        texts = ["".join(g) for g in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            word = np.array(found.word_ids)
            ends = [*(4 * (np.flatnonzero(np.diff(word)) + 1)).tolist(), 4 * len(word)]
            if len(ends) != len(group):
                raise ValueError("the tokenizer does not part words as expected")
            ids = _packed_ids(found.ids)
            self.known.update(zip(group, [ids[a:b] for a, b in zip([0, *ends], ends)]))
        others = [w for w in words if w[0] != " " or w.isspace()]
        self.known.update(zip(others, self._encoded(others)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._encoded(texts)
        lists = [self.full(t) if _is_odd(t) else self.plain(t) for t in texts]
        self._learn(list(set(chain.from_iterable(lists)).difference(self.known)))
        ids = [b"".join(map(self.known.__getitem__, x)) for x in lists]
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        return ids

    def forget(self) -> None:
        """Keeps only the words met first."""
        self.known = dict(islice(self.known.items(), KEPT_WORDS))


def _is_odd(text: str) -> bool:
    if text.isascii():
        return any(c in text for c in "\x1c\x1d\x1e\x1f")
    return _ODD.search(text) is not None


def _packed_ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_encoders: dict[int, Encoder] = {}


def _encoder(spec) -> Encoder:
    """The task's encoder; kept for the next task of this process."""
    key = hash(spec.value)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec.value)
    return _encoders[key]


def _all_ids(encode: Encoder, texts: list):
    """Ids of each text, encoded some texts at a time."""
    texts = [t or "" for t in texts]
    for a, b in text_slices(texts):
        yield from encode(texts[a:b])


def pieces(rows: DataFrame, tokenizer_path: str, capacity: int, waste: int) -> DataFrame:
    """The pieces of all rows (id, text) with class, task and number in both. Written once."""
    arrow_batches(rows.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = rows.sparkSession.sparkContext.broadcast(file.read())
    names = ["start", "length", "ids_crc32", "doc_tokens", "k", "nth"]

    def run(batches):
        encode, task = _encoder(spec), TaskContext.get().partitionId()
        counted: dict[int, int] = {}
        for batch in batches:
            out, source = [], []
            for i, ids in enumerate(_all_ids(encode, batch.column("text").to_pylist())):
                ids += END_ID.to_bytes(4, "little")
                n, start = len(ids) // 4, 0
                for size in cuts(n, capacity, waste):
                    k = capacity // size
                    nth = counted.get(k, 0)
                    counted[k] = nth + 1
                    crc = zlib.crc32(ids[4 * start : 4 * (start + size)])
                    out.append((start, size, crc, n, k, nth))
                    source.append(i)
                    start += size
            values = np.array(out, np.int64).reshape(-1, len(names))
            ids = batch.column("id").take(pa.array(source, pa.int32()))
            tasks = pa.array(np.full(len(out), task, np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(values[:, i]) for i in range(len(names))), tasks],
                ["id", *names, "task"],
            )
        # The process lives on, for tasks of other stages too.
        encode.forget()
        pa.default_memory_pool().release_unused()

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{n} bigint" for n in [*names, "task"])
    return write_once(rows.mapInArrow(run, schema), "pieces")


def _first_fit(rest: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Sequence and offset for a bounded number of pieces, longest first."""
    rest = rest.sort_values(["length", "k", "idx"], ascending=[False, True, True])
    room = np.full(len(rest), capacity, np.int64)
    seq, offset = [], []
    for size in rest["length"]:
        i = int(np.argmax(room >= size))
        seq.append(i)
        offset.append(capacity - int(room[i]))
        room[i] -= size
    return rest.assign(bin=seq, offset=offset)


def packed_sequences(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    capacity: int = CAPACITY,
    waste: int = WASTE,
) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    Ids of a text and then id 1; a null or empty text is id 1 alone. Pieces of a
    document follow each other without gaps, as do the pieces of a sequence and
    the sequence ids. Null ids and repeated rows are packed like any. An empty
    table gives no rows.
    """
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    found = pieces(keyed(documents, id_col, text_col), str(path), capacity, waste)
    spark = found.sparkSession
    counts = found.groupBy("task", "k").agg((F.max("nth") + 1).alias("n"))
    counts = write_once(counts, "piece-counts")
    # One row for each class: at most `capacity`, whatever the data.
    totals = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    base, bases = 0, []
    for k in sorted(totals):
        bases.append((k, base, totals[k] // k))
        base += totals[k] // k
    bases = spark.createDataFrame(bases, "k bigint, base bigint, whole bigint")
    before = Window.partitionBy("k").orderBy("task")
    before = before.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.withColumn("before", F.sum("n").over(before) - F.col("n")).drop("n")
    numbered = found.join(starts, ["task", "k"]).join(F.broadcast(bases), "k")
    idx = F.col("before") + F.col("nth")
    numbered = numbered.withColumn("idx", idx).withColumn("bin", F.floor(idx / F.col("k")))
    slot = Window.partitionBy("k", "bin").orderBy("idx")
    slot = slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = numbered.filter("bin < whole").select(
        *out,
        (F.col("base") + F.col("bin")).alias("sequence_id"),
        (F.sum("length").over(slot) - F.col("length")).alias("offset"),
    )
    rest = numbered.filter("bin >= whole").select(*out, "k", "idx")
    kind = found.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in [*out[1:], "k", "idx", "bin", "offset"])
    fitted = rest.groupBy((F.col("k") < 0).alias("all")).applyInPandas(lambda x: _first_fit(x, capacity), schema)
    fitted = fitted.select(*out, (F.col("bin") + base).alias("sequence_id"), "offset")
    return whole.unionByName(fitted)
