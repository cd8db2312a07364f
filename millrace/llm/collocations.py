"""Phrases that belong together, from count streams in prefix and in suffix order.

Tasks number the words of a block of text, sort the block's word sequences of one
and two, and send each with its count; Spark adds the counts up. A second scan does
the same for three words, for those whose pairs are frequent. The sequences that
occur often enough form one stream. It is laid out twice, sorted and cut in ranges:

- in prefix order (first word first), each sequence comes after its own beginnings,
  so one pass that remembers the last single word and the last pair merges the
  streams of all lengths in lockstep: every sequence learns the counts of its first
  word and first two words, and every pair the largest count of a triple it begins;
- in suffix order (last word first), the same pass tells the counts of endings, and
  the largest count of a triple that ends in the pair.

Nothing is looked up or hashed in a pass, and a task holds one batch of rows. The
range of a task may begin in the middle of a word's sequences, so tasks also note
what they saw last; a list with one row for each task then completes the others.
A word that begins a third of all sequences is spread over many ranges.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import arrow_batches, column, utf8, write_once
from millrace.operators.ranking import top_per_group

LONGEST = 3
LEAST = 10
COVERED = 50
UNKNOWN = "und"
# Words a task holds before it sorts them, and bytes of text it takes apart at a time.
HELD_WORDS = 3_000_000
CHUNK = 1 << 20
# Bits of the map of frequent pairs, at most: 64 MB.
MAP_BITS = 1 << 29
_GAP = b"\xff"  # in no UTF-8 text
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(
    bytes(range(65, 91)) + _ENDS, bytes(range(97, 123)) + _GAP * len(_ENDS)
)
_BLANK = re.compile(rb"[ \t\xff]")
_WORDS = ["w1", "w2", "w3"]


class _Numbers(dict):
    """Numbers words in the order they come, from 1; the gap between pieces has 0."""

    def __init__(self):
        super().__init__({_GAP: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _chunks(text: bytes):
    """The text in parts of about `CHUNK` bytes, cut only where no word is."""
    start = 0
    while len(text) - start > CHUNK:
        cut = _BLANK.search(text, start + CHUNK)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


class _Block:
    """Words of one language that a task has read and not yet counted."""

    def __init__(self):
        self.numbers, self.parts = _Numbers(), []

    def add(self, text: bytes) -> int:
        """Takes a text and tells its size; sequences do not go on from one text to the next."""
        size = 1
        for chunk in _chunks(text.translate(_TABLE)):
            words = chunk.replace(_GAP, b" \xff ").split()
            found = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
            self.parts.append(found.astype(np.int32))
            size += len(words)
        self.parts.append(np.zeros(1, np.int32))
        return size

    def counted(self, lang: str, orders: tuple[int, ...], pairs: np.ndarray | None = None):
        """Record batches (lang, phrase, n): the sequences of the block, sorted, by number.

        With `pairs`, a bit map, only triples of pairs that are in it.
        """
        ids = np.concatenate(self.parts).astype(np.int64)
        words = pa.array(list(self.numbers), pa.binary())
        bits = max(len(self.numbers).bit_length(), 1)
        key, whole = ids, ids > 0
        if 1 in orders:
            yield _sequences(lang, [], words, np.array([whole.sum()]))
        before = None  # the shorter sequences, where numbers stand for them
        for order in range(1, max(orders) + 1):
            if order > 1:
                if order * bits > 63:
                    before, key = np.unique(key, return_inverse=True)
                key = key[:-1] << bits | ids[order - 1 :]
                whole = whole[:-1] & (ids[order - 1 :] > 0)
            if order == LONGEST and pairs is not None:
                names = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, len(self.numbers))
                known = _marked(pairs, _pair_names(names[ids[:-1]], names[ids[1:]], lang))
                whole = whole & known[:-1] & known[1:]
            if not whole.any():
                return
            if order not in orders:
                continue
            keys, n = np.unique(key[whole], return_counts=True)
            low = (1 << bits) - 1
            parts = [keys & low]
            keys = keys >> bits if before is None else before[keys >> bits]
            for _ in range(order - 1):
                parts.insert(0, keys & low)
                keys = keys >> bits
            for a in range(0, len(n), 1 << 16):
                b = a + (1 << 16)
                yield _sequences(lang, [p[a:b] for p in parts], words, n[a:b])


def _sequences(lang: str, parts: list, words: pa.Array, n) -> pa.RecordBatch:
    phrase = pa.nulls(len(n), pa.binary())
    if parts:
        phrase = pc.binary_join_element_wise(*[words.take(pa.array(p)) for p in parts], b" ")
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(n), pa.string()), phrase.cast(pa.string()), pa.array(n.astype(np.int64))],
        ["lang", "phrase", "n"],
    )


def _pair_names(first: np.ndarray, second: np.ndarray, lang: str) -> np.ndarray:
    """A 64-bit name for each pair of named words."""
    own = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()) | 1)
    x = (first * np.uint64(0x9E3779B97F4A7C15) + second) * own
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _marked(bitmap: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether the bit of each name is set; the bit map has a power of two bits."""
    bit = names >> np.uint64(65 - (8 * len(bitmap)).bit_length())
    return bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1


def _blocks(documents: DataFrame, text_col: str, lang_col: str, orders: tuple[int, ...], pairs=None) -> DataFrame:
    """lang, phrase, n over all rows: how often sequences occur within pieces, added up."""
    arrow_batches(documents.sparkSession)
    rows = documents.select(
        F.coalesce(column(documents, lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.coalesce(column(documents, text_col).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches):
        blocks: dict[str, _Block] = {}
        held = 0
        bitmap = None if pairs is None else pairs.value

        def counted():
            for lang, block in blocks.items():
                yield from block.counted(lang, orders, bitmap)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                held += blocks.setdefault(lang, _Block()).add(text)
                if held > HELD_WORDS:
                    yield from counted()
                    blocks.clear()
                    held = 0
        yield from counted()

    found = rows.mapInArrow(run, "lang string, phrase string, n bigint")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _bitmap(pairs: DataFrame) -> np.ndarray:
    """A bit map of the names of `pairs` (lang, phrase): at most `MAP_BITS` bits, whatever their number.

    Beyond that it says yes too often, which costs time and changes no result.
    """
    size = min(max(1 << (16 * pairs.count()).bit_length(), 1 << 15), MAP_BITS)
    shift = np.uint64(65 - size.bit_length())

    def run(batches):
        for batch in batches:
            bits = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                words = [np.array([xxhash.xxh3_64_intdigest(w)], np.uint64) for w in phrase.encode().split(b" ")]
                bits.append(_pair_names(*words, lang) >> shift)
            if bits:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bits).astype(np.int64))], ["bit"])

    bits = pairs.select("lang", "phrase").mapInArrow(run, "bit bigint").groupBy(F.shiftright("bit", 15).alias("at"))
    out = np.zeros(size >> 3, np.uint8)
    for row in bits.agg(F.bitmap_construct_agg(F.col("bit") % (1 << 15)).alias("map")).collect():
        out[row["at"] << 12 : (row["at"] + 1) << 12] = np.frombuffer(row["map"], np.uint8)
    return out


def sequence_counts(
    documents: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST
) -> DataFrame:
    """lang, phrase, n: sequences of one to three words that occur `least` times or more.

    Words are joined by a blank; the row whose phrase is null counts all words of the
    language. A triple occurs no more often than its two pairs, so the second of
    two scans sends only triples whose pairs a bit map of the frequent ones has.
    Written once.
    """
    spark = documents.sparkSession
    kept = (F.col("n") >= least) | F.col("phrase").isNull()
    short = write_once(_blocks(documents, text_col, lang_col, (1, 2)).filter(kept), "sequences")
    bitmap = spark.sparkContext.broadcast(_bitmap(short.filter("contains(phrase, ' ')")))
    triples = _blocks(documents, text_col, lang_col, (LONGEST,), bitmap).filter(kept)
    return short.unionByName(write_once(triples, "sequences"))


def _carried(values: np.ndarray, at: np.ndarray, before: int) -> np.ndarray:
    """For each row the value of the last row marked in `at`, itself included; `before` if none."""
    last = np.maximum.accumulate(np.where(at, np.arange(len(at)), -1))
    return np.where(last >= 0, values[np.maximum(last, 0)], before)


def _pass(stream: DataFrame, words: list[str], one: str, two: str, most: str) -> DataFrame:
    """The stream sorted by lang and `words`, with what a lockstep pass over it tells.

    `one` and `two` are the counts of a sequence's first one and two of `words`,
    `most`, of a pair, the largest count of a triple that begins with it. Written
    once. Sequences must be there with all their beginnings.
    """
    spark = stream.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["lang", *words]
    laid = stream.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # The pair of a row that ends a task's range may go on in the next: `open`.
    extra = f"{one} bigint, {two} bigint, {most} bigint, part int, open boolean, ends boolean"
    names = [*stream.columns, one, two, most, "part", "open", "ends"]
    kinds = _arrow(stream, extra)

    def run(batches):
        part = TaskContext.get().partitionId()
        first = pair = 0  # counts last seen; 0 for none yet
        head = best = 0  # largest triple before any other row, and since the last other row
        started, waiting = False, None

        def closed(row, best, open_):
            return row.set_column(row.schema.get_field_index(most), most, pa.array([best], pa.int64())).set_column(
                row.schema.get_field_index("open"), "open", pa.array([open_])
            )

        for batch in batches:
            n = batch.column("n").to_numpy()
            order = sum(pc.is_valid(batch.column(w)).cast(pa.int8()).to_numpy() for w in _WORDS)
            single, double, triple = order == 1, order == 2, order == 3
            firsts, pairs = _carried(n, single, first), _carried(n, double, pair)
            first, pair = int(firsts[-1]), int(pairs[-1])
            out = pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(firsts),
                    pa.array(np.where(triple, pairs, 0)),
                    pa.array(np.zeros(len(n), np.int64)),
                    pa.array(np.full(len(n), part, np.int32)),
                    pa.array(np.zeros(len(n), bool)),
                    pa.array(np.zeros(len(n), bool)),
                ],
                names,
            )
            others = np.flatnonzero(~triple)
            edge = others[0] if len(others) else len(n)
            if edge:
                largest = int(n[:edge].max())
                best, head = max(best, largest), head if started else max(head, largest)
                yield out.slice(0, edge)
            if not len(others):
                continue
            if waiting is not None:
                yield closed(waiting, best, False)
            started = True
            held = np.where(triple, n, 0)
            runs = np.maximum.reduceat(held, others)
            values = np.zeros(len(n), np.int64)
            values[others] = runs
            out = out.set_column(out.schema.get_field_index(most), most, pa.array(values))
            last = others[-1]
            yield out.slice(edge, last - edge)
            waiting, best = out.slice(last, 1), int(runs[-1])
            yield out.slice(last + 1)
        if waiting is not None:
            yield closed(waiting, best, True)
        # What the task saw last, and the triples it began with.
        row = {c: None for c in names} | {
            "n": head, one: first, two: pair, "part": part, "open": started, "ends": True,
        }
        yield pa.RecordBatch.from_pylist([row], schema=kinds)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema) + ", " + extra
    found = write_once(laid.mapInArrow(run, schema), "phrases")
    return _completed(found, one, two, most)


def _arrow(stream: DataFrame, extra: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [(f.name, kinds[f.dataType.simpleString()]) for f in stream.schema]
    return pa.schema(fields + [(n, kinds[k]) for n, k in (x.split() for x in extra.split(", "))])


def _completed(found: DataFrame, one: str, two: str, most: str) -> DataFrame:
    """Gives rows at the edges of ranges what the neighbouring ranges know."""
    ends = found.filter("ends").select("part", one, two, F.col("n").alias("head"), F.col("open").alias("own"))
    ends = sorted(ends.collect())  # a row for each task
    before, first, pair = {}, 0, 0
    for part, last_one, last_two, _, _ in ends:
        before[part] = [first, pair]
        first, pair = last_one or first, last_two or pair
    after, best = {}, 0
    for part, _, _, head, own in reversed(ends):
        after[part] = best
        best = head if own else max(head, best)
    rows = [(part, *before[part], after[part]) for part in before]
    edges = found.sparkSession.createDataFrame(rows, "part int, one_ bigint, two_ bigint, most_ bigint")
    rows = found.filter("not ends").join(F.broadcast(edges), "part")
    fill = lambda name, other: F.when(F.col(name) == 0, F.col(other)).otherwise(F.col(name))
    triple = F.col("w3").isNotNull()
    return (
        rows.withColumn(one, fill(one, "one_"))
        .withColumn(two, F.when(triple, fill(two, "two_")).otherwise(0))
        .withColumn(most, F.when(F.col("open"), F.greatest(most, "most_")).otherwise(F.col(most)))
        .drop("part", "open", "ends", "one_", "two_", "most_")
    )


def _score(left: Column, right: Column) -> Column:
    """floor(1000000 n n / (left right)), exactly: at most 31 and 36 digits."""
    whole = lambda x, digits: x.cast(f"decimal({digits},0)")
    top = F.lit(1_000_000).cast("decimal(7,0)") * whole(F.col("n"), 15) * whole(F.col("n"), 15)
    return F.call_function("div", whole(top, 38), whole(left, 18) * whole(right, 18))


def collocations(
    documents: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    covered: int = COVERED,
    first: int = 2000,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each language.

    A-Z are lower-cased, texts cut at `.,;:!?` and line ends, and pieces at blanks
    and tabs. Phrases of two or three words that occur a >= `least` times score
    floor(1000000 a a / (l r)), where l and r count the two parts of the cut that
    scores lowest (of equal ones the first). A pair goes if a triple that holds it
    has `covered` percent of its count or more. n counts all words. Order is by
    score and a, falling, then phrase. Null texts are empty, a null language is
    `und`. Repeated rows count each time. Tables without phrases give no rows.
    """
    counts = sequence_counts(documents, text_col, lang_col, least)
    words = F.split("phrase", " ")
    words = [F.get(words, F.lit(i)).alias(w) for i, w in enumerate(_WORDS)]
    # The beginnings and endings of a phrase occur as often as it does, or more.
    stream = counts.filter("phrase is not null").select("lang", *words, "n")
    stream = _pass(stream, _WORDS, "begin1", "begin2", "longer1")
    # In suffix order: the last word first. Words that are not there come first.
    last = F.coalesce("w3", "w2", "w1")
    second = F.when(F.col("w3").isNotNull(), F.col("w2")).when(F.col("w2").isNotNull(), F.col("w1"))
    third = F.when(F.col("w3").isNotNull(), F.col("w1"))
    stream = stream.select("*", last.alias("e1"), second.alias("e2"), third.alias("e3"))
    stream = _pass(stream, ["e1", "e2", "e3"], "end1", "end2", "longer2")
    return ranked(stream, counts.filter("phrase is null").select("lang", F.col("n").alias("words")), covered, first)


def ranked(stream: DataFrame, words: DataFrame, covered: int, first: int) -> DataFrame:
    """The phrases of a stream that both passes have completed, by rank."""
    triple = F.col("w3").isNotNull()
    longer = F.greatest("longer1", "longer2").cast("decimal(20,0)")
    stays = triple | (longer * 100 < F.col("n").cast("decimal(20,0)") * covered)
    rows = stream.filter(F.col("w2").isNotNull() & stays)
    # A pair has one cut; a triple after its first word, or after its second.
    second = F.when(triple, F.col("end2")).otherwise(F.col("end1"))
    rows = rows.withColumn("cut1", _score(F.col("begin1"), second))
    rows = rows.withColumn("cut2", F.when(triple, _score(F.col("begin2"), F.col("end1"))))
    early = F.col("cut2").isNull() | (F.col("cut1") <= F.col("cut2"))
    rows = rows.select(
        "lang",
        F.concat_ws(" ", *_WORDS).alias("phrase"),
        F.col("n").alias("a"),
        F.when(early, F.col("begin1")).otherwise(F.col("begin2")).alias("l"),
        F.when(early, second).otherwise(F.col("end1")).alias("r"),
        F.when(early, F.col("cut1")).otherwise(F.col("cut2")).alias("score"),
    )
    rows = top_per_group(rows, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], first)
    return rows.join(words, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score"
    )
