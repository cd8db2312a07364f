"""Language identification by Kneser-Ney character models.

Texts become lower-case letters with a space for whatever stands between, and
start marks. A letter is its UTF-16 code: one sign of 16 bits, or two for letters
beyond, so no two letters are taken for each other. Each language has an interpolated Kneser-Ney model of
sequences of up to four signs: Spark counts sequences of four of all training texts,
and the counts of shorter ones, the number of different letters seen before them,
follow by aggregation. A text gets the language whose model gives it the lowest
cross-entropy per sign.

How sure that is comes from the margin to the second language, in units that do
not depend on length, by a monotone table measured on training texts that were
kept out of the counts; below a given score a text is rejected.

Sequences are kept exactly: four signs fill 64 bits, which are mixed without
loss. Models are sorted hash arrays with a column for each language. Those of at
most `BROADCAST_CELLS` sequences times languages are broadcast whole. Larger ones
stay in Spark tables, from which each slice of texts, of a bounded number of bytes,
gets a sorted array of its own: the distinct sequences of a slice are few, so what
travels is a fraction of the texts, and no sequence meets all texts that have it.
"""

from __future__ import annotations

import math
import unicodedata  # noqa: F401  (letters follow this Python's Unicode tables)
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import arrow_batches, column, keyed, write_once

ORDER = 4
# All of them: no two sequences share a place.
BITS = 64
# Sequences of all orders and languages, times languages, that are collected and broadcast.
BROADCAST_CELLS = 3 << 19
UNKNOWN = "und"
CALIBRATION_PARTS = 16
SLICE_CHARS = 1_000_000
# Characters of texts that share a sorted array of costs, where models are tables.
TABLE_SLICE = 16_000_000
FLUSH_ROWS = 1_000_000
MARGINS = 48
_START, _SPACE = 1, 32
_U = np.uint64
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or a space."""
    if "letters" not in _tables:
        table = np.full(0x110000, _SPACE, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        table[0] = _START
        _tables["letters"] = table
    return _tables["letters"]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of four that end at each sign, the text of each, and texts with a letter."""
    joined = "".join("\0\0\0" + t.replace("\0", " ") for t in texts)
    code = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER - 1)
    far = code > 0xFFFF
    if far.any():
        # Letters beyond 16 bits are two signs from ranges that no letter is in.
        wide = np.repeat(code, far + 1)
        text = np.repeat(text, far + 1)
        at = np.flatnonzero(far) + np.arange(far.sum())
        wide[at] = 0xD800 + ((code[far] - 0x10000) >> 10)
        wide[at + 1] = 0xDC00 + ((code[far] - 0x10000) & 0x3FF)
        code = wide
    start, space = code == _START, code == _SPACE
    some = np.bincount(text[~start & ~space], minlength=len(texts)) > 0
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & (space[:-1] | start[:-1]))
    code, text = code[keep].astype(_U), text[keep]
    gram = code.copy()
    for back in range(1, ORDER):
        gram[back:] |= code[:-back] << _U(16 * back)
    real = code != _START
    return gram[real], text[real], some


def _slices(texts: list):
    """(first row, texts) with a bounded number of characters; null is empty."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and size + len(text or "") > SLICE_CHARS:
            yield start, held
            start, held, size = i, [], 0
        held.append(text or "")
        size += len(text or "")
    if held:
        yield start, held


def _place(gram: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The hashed place of sequences of one order."""
    x = (gram + _U(order)) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return (x >> _U(64 - bits)).astype(np.int64)


def _last(gram: np.ndarray, order: int) -> np.ndarray:
    """The last `order` signs."""
    return gram & _U((1 << 16 * order) - 1)


def _counted(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows (text, lang). Written once."""

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def merged():
            for lang, parts in held.items():
                held[lang] = [pd.concat(parts).groupby(level=0).sum()]
            return sum(len(parts[0]) for parts in held.values())

        def out():
            for lang, (frame,) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(frame), pa.string()),
                        pa.array(frame.index.to_numpy().view(np.int64)),
                        pa.array(frame.to_numpy()),
                    ],
                    ["lang", "gram", "n"],
                )
            held.clear()

        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            by_lang: dict[str, list] = {}
            for lang, text in zip(langs, texts):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                for _, some in _slices(own):
                    codes, grams = pd.factorize(_grams(some)[0])
                    counts = pd.Series(np.bincount(codes, minlength=len(grams)), index=grams)
                    held.setdefault(lang, []).append(counts)
                    size += len(counts)
            if size > FLUSH_ROWS:
                size = merged()
                if size > FLUSH_ROWS // 2:
                    yield from out()
                    size = 0
        merged()
        yield from out()

    found = rows.mapInArrow(run, "lang string, gram bigint, n bigint")
    found = found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return write_once(found, "language-counts")


def _orders(counts: DataFrame) -> DataFrame:
    """lang, place, gram, n for all orders: below the highest, n counts what stands before."""
    now, parts = counts.select("lang", "gram", "n"), []
    for order in range(ORDER, 0, -1):
        parts.append(now.withColumn("place", F.lit(order)))
        tail = F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1).cast("bigint"))
        now = now.groupBy("lang", tail.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("place", "rank")


def _hashed(orders: DataFrame, bits: int) -> DataFrame:
    """Counts by hashed place, with the places of the context and of the shorter sequence."""

    def run(batches):
        for batch in batches:
            gram = batch.column("gram").to_numpy().view(_U)
            rank = batch.column("rank").to_numpy()
            places = np.zeros((3, len(gram)), np.int64)
            for order in range(1, ORDER + 1):
                at = rank == order
                own = gram[at]
                places[0, at] = _place(own, order, bits)
                places[1, at] = _place(own >> _U(16), order - 1, bits)
                places[2, at] = _place(_last(own, order - 1), order - 1, bits) if order > 1 else 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("rank"), *map(pa.array, places), batch.column("n")],
                ["lang", "rank", "own", "context", "shorter", "n"],
            )

    schema = "lang string, rank int, own bigint, context bigint, shorter bigint, n bigint"
    rows = orders.mapInArrow(run, schema)
    return rows.groupBy("lang", "rank", "own").agg(
        F.sum("n").alias("n"),
        F.max_by("context", "n").alias("context"),
        F.max_by("shorter", "n").alias("shorter"),
    )


@dataclass
class Models:
    """Sorted hash arrays: for each order, places and a column of log probabilities per language.

    NaN stands for what a language has not seen. `weights` has, for each order,
    the logarithm of what a context leaves to shorter sequences.
    """

    langs: list[str]
    bits: int
    probabilities: list
    weights: list
    margins: np.ndarray | None = None
    right: np.ndarray | None = None

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Negative log probability of the last character of each sequence, per language."""
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        open_ = np.ones_like(out, bool)
        for order in range(ORDER, 0, -1):
            own = _last(grams, order)
            found = _looked_up(self.probabilities[order], _place(own, order, self.bits), np.nan)
            left = _looked_up(self.weights[order], _place(own >> _U(16), order - 1, self.bits), 0.0)
            seen = open_ & ~np.isnan(found)
            out[seen] -= found[seen]
            open_ &= ~seen
            out[open_] -= left[open_]
        out[open_] += math.log(0x10000)
        return out

    def chosen(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `_chosen`, by these models."""
        return _chosen(texts, self.costs, len(self.langs))


def _chosen(texts: list[str], costs_of, langs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the best language, margin, and whether there is a letter; ties go to the first.

    `costs_of` gives the cost of each of some distinct sequences by language. The
    margin is of the cross-entropies per sign.
    """
    grams, text, some = _grams(texts)
    codes, kinds = pd.factorize(grams)
    sizes = np.bincount(text, minlength=len(texts))
    sums = np.zeros((len(texts), langs))
    full = np.flatnonzero(sizes)
    if len(full):
        costs = costs_of(kinds)
        starts = (np.cumsum(sizes) - sizes)[full]
        for i in range(langs):
            sums[full, i] = np.add.reduceat(costs[codes, i], starts, dtype=np.float64)
    entropy = sums / np.maximum(sizes, 1)[:, None]
    order = np.sort(entropy, axis=1)
    gap = order[:, 1] - order[:, 0] if langs > 1 else np.ones(len(texts))
    return np.argmin(entropy, axis=1), gap * np.sqrt(sizes), some


def _looked_up(table: tuple, places: np.ndarray, missing: float) -> np.ndarray:
    keys, values = table
    at = np.minimum(np.searchsorted(keys, places), len(keys) - 1)
    out = values[at]
    out[keys[at] != places] = missing
    return out


def _built(rows: pd.DataFrame, langs: list[str], bits: int) -> Models:
    """Models from hashed counts."""
    index = {lang: i for i, lang in enumerate(langs)}
    probabilities, weights = [None] * (ORDER + 1), [None] * (ORDER + 1)
    for order in range(1, ORDER + 1):
        part = rows[rows["rank"] == order]
        keys = np.unique(part["own"].to_numpy())
        contexts = np.unique(part["context"].to_numpy())
        table = np.full((len(keys), len(langs)), np.nan, np.float32)
        left = np.zeros((len(contexts), len(langs)), np.float32)
        for lang, own in part.groupby("lang"):
            n = own["n"].to_numpy().astype(float)
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once else 0.5
            discount = min(max(discount, 0.1), 0.9)
            at = np.searchsorted(contexts, own["context"].to_numpy())
            total = np.bincount(at, n, len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            seen = total > 0
            rest = np.ones(len(contexts))
            rest[seen] = discount * kinds[seen] / total[seen]
            if order == 1:
                shorter = np.full(len(n), 1 / 0x10000)
            else:
                below, values = probabilities[order - 1]
                found = np.searchsorted(below, own["shorter"].to_numpy())
                shorter = np.exp(values[np.minimum(found, len(below) - 1), index[lang]])
            p = (n - discount) / total[at] + rest[at] * shorter
            table[np.searchsorted(keys, own["own"].to_numpy()), index[lang]] = np.log(p)
            left[seen, index[lang]] = np.log(rest[seen])
        probabilities[order], weights[order] = (keys, table), (contexts, left)
    return Models(langs, bits, probabilities, weights)


def _tail(order: int) -> Column:
    """The last signs of a sequence of this order, all but the first."""
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1).cast("bigint"))


def _head(order: int) -> Column:
    """All signs of a sequence of this order but the last."""
    return F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("bigint")


@dataclass
class Tables:
    """Models too large to broadcast, as Spark tables.

    `probabilities` has lang, rank, gram, p; `weights` lang, rank, context, left, as
    in `Models`. No key of a join has more rows than there are letters, times languages.
    """

    names: list[str]
    langs: DataFrame
    probabilities: DataFrame
    weights: DataFrame
    right: np.ndarray | None = None

    def costs(self, grams: DataFrame) -> DataFrame:
        """gram, lang, cost for every language and row of `grams` (distinct, of the highest order)."""
        tails = [None] * ORDER + [grams]
        for order in range(ORDER, 1, -1):
            tails[order - 1] = tails[order].select(_tail(order).alias("gram")).distinct()
        now = tails[1].crossJoin(self.langs).withColumn("below", F.lit(math.log(0x10000)))
        for order in range(1, ORDER + 1):
            if order > 1:
                under = now.select(F.col("gram").alias("tail"), "lang", F.col("cost").alias("below"))
                now = tails[order].withColumn("tail", _tail(order)).join(under, "tail")
            own = self.probabilities.filter(F.col("rank") == order).select("lang", "gram", "p")
            left = self.weights.filter(F.col("rank") == order).select("lang", "context", "left")
            now = now.withColumn("context", _head(order)).join(left, ["lang", "context"], "left")
            now = now.join(own, ["lang", "gram"], "left")
            cost = F.coalesce(-F.col("p"), F.col("below") - F.coalesce("left", F.lit(0.0)))
            now = now.select("gram", "lang", cost.alias("cost"))
        return now

    def chosen(self, rows: DataFrame) -> DataFrame:
        """id, best, margin, letter for every row (id, text); see `_chosen`.

        Texts are dealt into slices. Each slice sends its distinct sequences and
        gets their costs as one sorted array, whatever the size of the models.
        """
        names = self.names
        kind = rows.schema["id"].dataType.simpleString()
        texts = write_once(_sliced(rows), "language-texts")
        asked = write_once(_asked(texts), "language-asked")
        costs = self.costs(asked.select("gram").distinct()).groupBy("gram")
        costs = costs.agg(F.sort_array(F.collect_list(F.struct("lang", "cost"))).alias("costs"))
        costs = costs.select("gram", F.col("costs.cost").cast("array<float>").alias("costs"))
        costs = write_once(costs, "language-costs")
        found = asked.join(costs, "gram").groupBy("slice")

        def run(texts: pa.Table, found: pa.Table) -> pa.Table:
            keys = found.column("gram").to_numpy()
            first = np.argsort(keys, kind="stable")
            values = found.column("costs").combine_chunks().flatten().to_numpy().reshape(-1, len(names))[first]
            keys = keys[first]

            def costs_of(grams):
                return values[np.searchsorted(keys, grams.view(np.int64))]

            best, margin, letter = [], [], []
            for _, some in _slices(texts.column("text").to_pylist()):
                a, b, c = _chosen(some, costs_of, len(names))
                best += [names[i] for i in a]
                margin.append(b)
                letter.append(c)
            return pa.table({
                "id": texts.column("id"),
                "best": pa.array(best, pa.string()),
                "margin": pa.array(np.concatenate([*margin, np.empty(0)])),
                "letter": pa.array(np.concatenate([*letter, np.empty(0, bool)]), pa.bool_()),
            })

        schema = f"id {kind}, best string, margin double, letter boolean"
        return texts.groupBy("slice").cogroup(found).applyInArrow(run, schema)


def _sliced(rows: DataFrame) -> DataFrame:
    """slice, id, text: rows dealt into slices of about `TABLE_SLICE` characters; a longer text is one."""

    def run(batches):
        task, number, held = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if held and held + len(text or "") > TABLE_SLICE:
                    number, held = number + 1, 0
                held += len(text or "") + 1
                out.append(task + number)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.int64()), *batch.columns], ["slice", "id", "text"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text").mapInArrow(run, f"slice bigint, id {kind}, text string")


def _asked(texts: DataFrame) -> DataFrame:
    """slice, gram: the distinct sequences of each slice; again where a slice is in two tasks."""

    def run(batches):
        slice_, held = None, []

        def out():
            grams = np.unique(np.concatenate(held)).view(np.int64)
            own = pa.array(np.full(len(grams), slice_))
            return pa.RecordBatch.from_arrays([own, pa.array(grams)], ["slice", "gram"])

        for batch in batches:
            slices = batch.column("slice").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(slices)) + 1).tolist(), len(slices)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if slices[a] != slice_ and held:
                    yield out()
                    held = []
                slice_ = slices[a]
                for _, some in _slices(batch.column("text").slice(a, b - a).to_pylist()):
                    held.append(np.unique(_grams(some)[0]))
                if len(held) > 8:
                    held = [np.unique(np.concatenate(held))]
        if held:
            yield out()

    return texts.select("slice", "text").mapInArrow(run, "slice bigint, gram bigint")


def _tabled(orders: DataFrame) -> Tables:
    """Models as tables, from counts of all orders (lang, rank, gram, n)."""
    once, twice = (F.count(F.when(F.col("n") == k, 1)) for k in (1, 2))
    share = F.when(once > 0, once / (once + 2 * twice)).otherwise(0.5)
    share = F.least(F.greatest(share, F.lit(0.1)), F.lit(0.9))
    discounts = orders.groupBy("lang", "rank").agg(share.alias("d"))
    head = F.when(F.col("rank") == 1, F.lit(0).cast("bigint")).otherwise(F.shiftrightunsigned("gram", 16))
    rows = orders.withColumn("context", head)
    totals = rows.groupBy("lang", "rank", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    totals = totals.join(discounts, ["lang", "rank"])
    totals = totals.withColumn("rest", F.col("d") * F.col("kinds") / F.col("total"))
    totals = write_once(totals, "language-weights")
    below, parts = None, []
    for order in range(1, ORDER + 1):
        own = rows.filter(F.col("rank") == order).drop("rank")
        own = own.join(totals.filter(F.col("rank") == order), ["lang", "context"])
        if below is None:
            own = own.withColumn("shorter", F.lit(1 / 0x10000))
        else:
            shorter = below.select("lang", F.col("gram").alias("tail"), F.exp("p").alias("shorter"))
            own = own.withColumn("tail", _tail(order)).join(shorter, ["lang", "tail"])
        p = F.log((F.col("n") - F.col("d")) / F.col("total") + F.col("rest") * F.col("shorter"))
        below = write_once(own.select("lang", "rank", "gram", p.alias("p")), "language-probabilities")
        parts.append(below)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    weights = totals.select("lang", "rank", "context", F.log("rest").alias("left"))
    langs = write_once(orders.select("lang").distinct(), "languages")
    return Tables(sorted(r["lang"] for r in langs.collect()), langs, found, weights)


def _binned() -> Column:
    """As `_bin`, of the column `margin`."""
    scaled = 8 * F.log2(F.greatest("margin", F.lit(1e-9)) * 4)
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(float(MARGINS - 1))).cast("bigint")


def _calibrated(models: Models | Tables, rows: DataFrame) -> Models | Tables:
    """Share of right answers by margin, over rows (text, lang) kept out of the counts."""
    if isinstance(models, Tables):
        found = models.chosen(rows.select(F.col("lang").alias("id"), "text")).filter("letter")
        found = found.select(_binned().alias("bin"), (F.col("id") == F.col("best")).cast("int").alias("right"))
        found = found.groupBy("bin").agg(F.sum("right").alias("hits"), F.count(F.lit(1)).alias("n"))
        return _with_shares(models, found)
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for a, some in _slices(texts):
                best, margin, letter = sent.value.chosen(some)
                right = [sent.value.langs[i] == x for i, x in zip(best, langs[a : a + len(some)])]
                frame = pd.DataFrame({"bin": _bin(margin), "right": right})[letter]
                sums = frame.groupby("bin")["right"].agg(["sum", "count"]).reset_index()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sums[c].astype("int64")) for c in ("bin", "sum", "count")],
                    ["bin", "hits", "n"],
                )

    found = rows.mapInArrow(run, "bin bigint, hits bigint, n bigint")
    found = found.groupBy("bin").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
    models.margins = np.arange(MARGINS)
    return _with_shares(models, found)


def _with_shares(models: Models | Tables, found: DataFrame) -> Models | Tables:
    """`models` with the share of right answers for each margin, from counts (bin, hits, n)."""
    hits, n = np.zeros(MARGINS), np.zeros(MARGINS)
    for row in found.collect():
        hits[row["bin"]], n[row["bin"]] = row["hits"], row["n"]
    models.right = _monotone(hits + 1, n + 2)
    return models


def _bin(margin: np.ndarray) -> np.ndarray:
    """Margins in 48 bins, eight to each doubling."""
    scaled = 8 * np.log2(np.maximum(margin, 1e-9) * 4)
    return np.clip(scaled, 0, MARGINS - 1).astype(np.int64)


def _monotone(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Shares that do not fall, nearest to hits / n: neighbours that fall are pooled."""
    pools: list[list] = []
    for h, m in zip(hits, n):
        pools.append([h, m, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] > pools[-1][0] * pools[-2][1]:
            h, m, k = pools.pop()
            pools[-1] = [pools[-1][0] + h, pools[-1][1] + m, pools[-1][2] + k]
    return np.concatenate([np.full(k, h / m) for h, m, k in pools])


def trained(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> Models | Tables | None:
    """Models from all rows with text and language; None if there are none."""
    arrow_batches(documents.sparkSession)
    rows = documents.select(
        column(documents, text_col).cast("string").alias("text"),
        column(documents, lang_col).cast("string").alias("lang"),
    ).filter("text is not null and lang is not null")
    kept_out = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION_PARTS)) == 0
    counts = _counted(rows.filter(~kept_out))
    orders = write_once(_orders(counts), "language-orders")
    size = orders.count()
    if not size:
        return None
    if size * orders.select("lang").distinct().count() > BROADCAST_CELLS:
        return _calibrated(_tabled(orders), rows.filter(kept_out))
    found = _hashed(orders, bits).toPandas()
    models = _built(found, sorted(found["lang"].unique()), bits)
    return _calibrated(models, rows.filter(kept_out))


def identified(
    documents: DataFrame,
    models: Models | Tables | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    reject_below: float = 0.0,
) -> DataFrame:
    """id, lang, score (0 to 1), for every row.

    A text that is null or has no letter, or scores below `reject_below`, is
    `und`; so is every text without models. Ties go to the language that sorts
    first. Repeated rows and null ids each get a row.
    """
    arrow_batches(documents.sparkSession)
    rows = keyed(documents, id_col, text_col)
    if models is None:
        return rows.select("id", F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if isinstance(models, Tables):
        found = models.chosen(rows).withColumn("bin", _binned().cast("int"))
        shares = F.array(*[F.lit(float(x)) for x in models.right])
        score = F.when(F.col("letter"), F.element_at(shares, F.col("bin") + 1)).otherwise(0.0)
        found = found.withColumn("score", score)
        known = F.col("letter") & (F.col("score") >= reject_below)
        return found.select("id", F.when(known, F.col("best")).otherwise(UNKNOWN).alias("lang"), "score")
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        models = sent.value
        for batch in batches:
            for a, some in _slices(batch.column("text").to_pylist()):
                best, margin, letter = models.chosen(some)
                score = np.where(letter, models.right[_bin(margin)], 0.0)
                known = letter & (score >= reject_below)
                lang = [models.langs[i] if k else UNKNOWN for i, k in zip(best, known)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, len(some)), pa.array(lang, pa.string()), pa.array(score)],
                    ["id", "lang", "score"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang string, score double")


def fold(key: Column, parts: int) -> Column:
    """crc32 of a key as text, modulo `parts`; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))
