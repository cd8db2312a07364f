"""Byte-pair encoding and decoding as streams, in constant memory.

Whether two neighbouring tokens merge depends on what follows only through a chain:
the right one may be taken by its own right neighbour in an earlier merge, that
one by its neighbour in a still earlier merge, and so on, with falling ranks. The
longest such chain follows from the merge list in one pass by rank. It is the
lookahead that suffices: a token is settled once so many bytes behind its end are
known, whatever comes later.

The encoder keeps the bytes since the last settled token. When there are enough it
merges what it holds, emits the tokens that are settled and drops their bytes, so
a word of any length takes the same memory. Words that a task has met are kept,
up to a bound. The decoder puts the bytes of tokens into a state machine that
gives out characters as they are complete and the replacement character for
bytes that begin none.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import arrow_batches, column, keyed, text_slices
from millrace.llm.packing import _PLAIN, BYTE_LEVEL, _is_odd

# Words a task keeps, and the bytes up to which it keeps them.
KNOWN_WORDS = 400_000
KNOWN_BYTES = 64
# Bytes the encoder takes at a time, beyond the lookahead.
STEP = 1024
# Ids the decoder takes at a time.
IDS = 1 << 16
# Bytes up to which all pairs are looked through for each merge.
SHORT = 48
_ID = (1 << 24) - 1
_NONE = 1 << 62


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


def lookaheads(merges: list[tuple[int, int, int]], sizes: dict[int, int]) -> dict[int, int]:
    """For each token the bytes behind its end that can have a say in whether it is one.

    `merges` lists (left, right, merged) by rank. A token is as its left part found
    it: its right part, and the right part of that, must not have been taken from
    the right before.
    """
    after: dict[int, int] = {}  # as the left one of a merge so far
    inside: dict[int, int] = {}  # until a token is there at all

    def known(token):
        return max(after.get(token, 0), inside.get(token, 0))

    for left, right, merged in merges:
        needs = known(right)
        inside[merged] = max(inside.get(merged, 0), needs)
        after[left] = max(after.get(left, 0), sizes[right] + needs)
    return {token: known(token) for token in sizes}


class Vocabulary:
    """Merges, token bytes and lookahead of a byte-level tokenizer file of `tokenizers`."""

    def __init__(self, spec: str):
        parts = json.loads(spec)
        model, pre = parts["model"], parts.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not parts.get("normalizer")
        odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        if not plain or not pre.get("use_regex", True) or model["type"] != "BPE" or any(model.get(k) for k in odd):
            raise ValueError("only byte-level BPE without options is supported")
        ids = model["vocab"]
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        self.bytes = {i: bytes(byte_of[c] for c in word) for word, i in ids.items()}
        self.letters = [ids[c] for c in byte_letters()]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        # For each pair its rank and, in the low bits, what it becomes.
        self.ranks = {(a, b): rank * (_ID + 1) + c for rank, (a, b, c) in reversed(list(enumerate(merges)))}
        sizes = {i: len(x) for i, x in self.bytes.items()}
        self.lookahead = max(lookaheads(merges, sizes).values())
        self.longest = max(sizes.values())
        added = {x["content"]: x["id"] for x in parts.get("added_tokens", [])}
        self.added = added
        self.bytes |= {i: x.encode() for x, i in added.items()}
        found = "|".join(map(re.escape, sorted(added, key=len, reverse=True)))
        self.split = re.compile(f"({found})").split if added else lambda text: [text]

    def merged(self, word: bytes) -> list[int]:
        """Ids of a run of bytes: the merge of lowest rank first, of equal ones the leftmost."""
        ids = [self.letters[b] for b in word]
        return self._scanned(ids) if len(ids) <= SHORT else self._queued(ids)

    def _scanned(self, ids: list[int]) -> list[int]:
        """As `merged`, looking through all pairs for each merge: best for a few bytes."""
        rank_of = self.ranks.get
        found = list(map(rank_of, zip(ids, ids[1:]), repeat(_NONE)))
        while found:
            best = min(found)
            if best == _NONE:
                break
            i = found.index(best)
            ids[i : i + 2] = [new := best & _ID]
            del found[i]
            if i < len(found):
                found[i] = rank_of((new, ids[i + 1]), _NONE)
            if i:
                found[i - 1] = rank_of((ids[i - 1], new), _NONE)
        return ids

    def _queued(self, ids: list[int | None]) -> list[int]:
        """As `merged`, with a queue of pairs: in proportion to the bytes, but for a logarithm."""
        n, rank_of = len(ids), self.ranks.get
        following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i) for i, r in enumerate(map(rank_of, zip(ids, ids[1:]), repeat(_NONE))) if r != _NONE]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = following[i]
            if ids[i] is None or j >= n or rank_of((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank & _ID, None
            k = following[i] = following[j]
            if k < n:
                previous[k] = i
            for a, b in ((i, k), (previous[i], i)):
                if a >= 0 and b < n and (rank := rank_of((ids[a], ids[b]))) is not None:
                    heapq.heappush(queue, (rank, a))
        return [x for x in ids if x is not None]


class Encoder:
    """A transducer from the bytes of one word to ids; holds a bounded number of bytes."""

    def __init__(self, vocabulary: Vocabulary, step: int = STEP):
        self.vocabulary, self.held = vocabulary, b""
        self.enough = vocabulary.lookahead + vocabulary.longest + step

    def feed(self, data: bytes):
        """Ids that are settled once `data` has been read."""
        for start in range(0, len(data), self.enough):
            self.held += data[start : start + self.enough]
            if len(self.held) >= self.enough:
                yield from self._settled()

    def _settled(self):
        end, settled = 0, len(self.held) - self.vocabulary.lookahead
        for token in self.vocabulary.merged(self.held):
            size = len(self.vocabulary.bytes[token])
            if end + size > settled:
                break
            end += size
            yield token
        self.held = self.held[end:]

    def finish(self):
        """The ids that are left when the word has ended."""
        yield from self.vocabulary.merged(self.held)
        self.held = b""


class Decoder:
    """A state machine from ids to text; holds the bytes of one character that is not complete."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = vocabulary.bytes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        """Text that is complete once `ids` have been read; ids that do not exist have none."""
        return self.machine.decode(b"".join(map(self.bytes.get, ids, repeat(b""))))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


class _Known(dict):
    """Ids of words, as bytes of 32-bit numbers, found when they are first asked for and kept up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        if len(data) <= self.vocabulary.lookahead:
            # Nothing is settled before the end.
            found = self.vocabulary.merged(data)
        else:
            encoder = Encoder(self.vocabulary)
            found = chain(encoder.feed(data), encoder.finish())
        ids = array("i", found).tobytes()
        if len(data) <= KNOWN_BYTES:
            if len(self) >= KNOWN_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Tokenizer:
    """Encodes whole texts word by word and decodes ids, keeping words it has met."""

    def __init__(self, spec: str):
        self.vocabulary = Vocabulary(spec)
        self.plain, self.full = re.compile(_PLAIN).findall, regex.compile(BYTE_LEVEL).findall
        self.known = _Known(self.vocabulary)

    def encode(self, text: str) -> np.ndarray:
        parts = []
        for i, part in enumerate(self.vocabulary.split(text)):
            if i % 2:
                parts.append(array("i", [self.vocabulary.added[part]]).tobytes())
                continue
            words = self.full(part) if _is_odd(part) else self.plain(part)
            parts.extend(map(self.known.__getitem__, words))
        return np.frombuffer(b"".join(parts), np.intc)

    def decode(self, ids) -> str:
        decoder = Decoder(self.vocabulary)
        parts = [decoder.feed(ids[a : a + IDS].tolist()) for a in range(0, len(ids), IDS)]
        return "".join(parts) + decoder.finish()


_tokenizers: dict[int, Tokenizer] = {}


def _tokenizer(spec) -> Tokenizer:
    """The task's tokenizer; kept for the next task of this process."""
    key = hash(spec.value)
    if key not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[key] = Tokenizer(spec.value)
    return _tokenizers[key]


def _sent(spark, tokenizer_path: str | None):
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encoded(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None
) -> DataFrame:
    """id, ids (array of int), for every row, as the library `tokenizers` encodes its text.

    A string that is an added token of the tokenizer becomes that token; nothing is
    added. Null and empty texts have no ids. Repeated rows and null ids each get a
    row. An empty table gives no rows. The tokenizer is a byte-level BPE file.
    """
    arrow_batches(documents.sparkSession)
    rows, spec = keyed(documents, id_col, text_col), _sent(documents.sparkSession, tokenizer_path)

    def run(batches):
        tokenizer = _tokenizer(spec)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in text_slices(texts, 4 << 20):
                lists = [tokenizer.encode(t) for t in texts[a:b]]
                edges = np.cumsum([0, *map(len, lists)])
                ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), ids], ["id", "ids"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decoded(rows: DataFrame, ids_col: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """All columns of `rows` as a struct `row`, and `text`: what the ids say.

    Added tokens stand as their strings, bytes that are no UTF-8 as U+FFFD, and ids
    that do not exist, or are null, as nothing. Null ids give an empty text.
    """
    arrow_batches(rows.sparkSession)
    spec = _sent(rows.sparkSession, tokenizer_path)
    packed = rows.select(
        F.struct(*[column(rows, c).alias(c) for c in rows.columns]).alias("row"),
        F.filter(F.coalesce(column(rows, ids_col).cast("array<int>"), F.array()), F.isnotnull).alias("ids"),
    )

    def run(batches):
        tokenizer = _tokenizer(spec)
        for batch in batches:
            ids = batch.column("ids")
            values, edges = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            texts = [tokenizer.decode(values[a:b]) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, text string")
