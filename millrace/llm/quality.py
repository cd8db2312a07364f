"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text is put in bins and has a lookup table; chosen pairs have a
table over coarser bins of both. Tables are learned by boosting in turn: for each
feature a shallow tree over its bins is fitted to what the sum of all tables still
gets wrong, and a small part of it is added to the feature's table. A score is the
sum of one number from each table: no trees are kept.

The model is fitted on at most `SAMPLE` labelled rows, drawn by a hash of the id,
so what reaches the driver is bounded; features and scores are computed over the
whole of all texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import arrow_batches, column, keyed, packed, utf8

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAST = 150, 60, 0.1, 10
_PARTS = 1 << 20

FEATURES = (
    "bytes", "words", "upper", "digits", "spaces", "lines", "marks", "bars", "shouts", "stops",
    "non_ascii", "distinct", "commonest", "repeated", "distinct_threes", "word_bytes", "short_words",
    "marked_words", "packs_to", "same_lines", "line_words",
)


def features_of(text: bytes) -> list[float]:
    """The features of a whole text; zeros where there is nothing to count."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [float(np.log1p(size)), *[0.0] * (len(FEATURES) - 1)]
    kinds = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower = kinds[65:91].sum(), kinds[97:123].sum()
    spaces = kinds[32] + kinds[9:14].sum()
    digits, high = kinds[48:58].sum(), kinds[128:].sum()
    marks = size - upper - lower - spaces - digits - high
    names = np.fromiter(map(hash, words), np.int64, n)
    threes = names[:-2] * 3 + names[1:-1] * 5 + names[2:] * 7
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    ends_marked = ((ends < 48) | ((ends > 57) & (ends < 65)) | ((ends > 90) & (ends < 97)) | ((ends > 122) & (ends < 128))).sum()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(size)),
        float(np.log1p(n)),
        upper / max(upper + lower, 1),
        digits / size,
        spaces / size,
        kinds[10] / n,
        marks / size,
        kinds[124] / n,
        (kinds[33] + kinds[63]) / n,
        (kinds[46] + kinds[44]) / n,
        high / size,
        len(counts) / n,
        max(counts.values()) / n,
        float((names[1:] == names[:-1]).mean()) if n > 1 else 0.0,
        len(np.unique(threes)) / len(threes) if len(threes) else 1.0,
        float(sizes.mean()),
        float((sizes <= 3).mean()),
        ends_marked / n,
        len(zlib.compress(text, 1)) / size,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
    ]


def features(texts: list[bytes]) -> np.ndarray:
    return np.array([features_of(t) for t in texts], np.float32).reshape(-1, len(FEATURES))


@dataclass
class Model:
    """Bin edges and lookup tables: `tables` per feature, `pairs` as (i, j, table)."""

    start: float
    edges: list
    tables: list
    coarse: list
    pairs: list

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for rows of features: one table entry each, added up."""
        total = np.full(len(x), self.start)
        for i, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[i], x[:, i], "right")]
        for i, j, table in self.pairs:
            a = np.searchsorted(self.coarse[i], x[:, i], "right")
            total += table[a, np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])).astype(np.float32)


def _cut(grad: np.ndarray, hess: np.ndarray, count: np.ndarray, low: int, high: int):
    """Gain and place of the best cut of bins low..high in two."""
    g, h, c = (np.cumsum(x[low:high])[:-1] for x in (grad, hess, count))
    gall, hall, call = grad[low:high].sum(), hess[low:high].sum(), count[low:high].sum()
    ok = (c >= LEAST) & (call - c >= LEAST)
    if not ok.any():
        return 0.0, None
    gain = g**2 / (h + 1) + (gall - g) ** 2 / (hall - h + 1) - gall**2 / (hall + 1)
    gain = np.where(ok, gain, -1)
    at = int(np.argmax(gain))
    return float(gain[at]), low + at + 1


def _tree(grad: np.ndarray, hess: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Step of each bin by a tree of at most four leaves."""
    leaves = [(0, len(grad))]
    for _ in range(3):
        best = max(((*_cut(grad, hess, count, a, b), a, b) for a, b in leaves), key=lambda x: x[0])
        gain, at, a, b = best
        if at is None or gain <= 1e-9:
            break
        leaves.remove((a, b))
        leaves += [(a, at), (at, b)]
    out = np.zeros(len(grad))
    for a, b in leaves:
        out[a:b] = grad[a:b].sum() / (hess[a:b].sum() + 1)
    return out


def _quarters(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of the best cut of a two-way table in four quarters."""
    n, m = grad.shape
    g = np.cumsum(np.cumsum(grad, 0), 1)
    h = np.cumsum(np.cumsum(hess, 0), 1)
    best, where = -1.0, None
    for i in range(n - 1):
        for j in range(m - 1):
            gs = np.array([g[i, j], g[i, -1] - g[i, j], g[-1, j] - g[i, j], g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j]])
            hs = np.array([h[i, j], h[i, -1] - h[i, j], h[-1, j] - h[i, j], h[-1, -1] - h[i, -1] - h[-1, j] + h[i, j]])
            gain = float((gs**2 / (hs + 1)).sum())
            if gain > best:
                best, where = gain, (i + 1, j + 1, gs / (hs + 1))
    out = np.zeros(grad.shape)
    if where is None:
        return 0.0, out
    i, j, step = where
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = step
    return best - float(g[-1, -1] ** 2 / (h[-1, -1] + 1)), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model from rows of features and labels 0 or 1; a constant one if labels do not differ."""
    n, ones = len(y), float(y.sum())
    start = float(np.log((ones + 1) / (n - ones + 1)))
    width = len(FEATURES)
    if not 0 < ones < n:
        none = np.empty(0, np.float32)
        return Model(start, [none] * width, [np.zeros(1)] * width, [none] * width, [])
    edges = [_edges(x[:, i], BINS) for i in range(width)]
    bins = [np.searchsorted(edges[i], x[:, i], "right") for i in range(width)]
    counts = [np.bincount(b, minlength=len(e) + 1) for b, e in zip(bins, edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(n, start)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i in range(width):
            grad, hess = slopes()
            step = RATE * _tree(
                np.bincount(bins[i], grad, len(tables[i])),
                np.bincount(bins[i], hess, len(tables[i])),
                counts[i],
            )
            tables[i] += step
            total += step[bins[i]]
    coarse = [_edges(x[:, i], PAIR_BINS) for i in range(width)]
    cells = [np.searchsorted(coarse[i], x[:, i], "right") for i in range(width)]

    def crossed(i, j, values):
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        at = cells[i] * shape[1] + cells[j]
        return np.bincount(at, values, shape[0] * shape[1]).reshape(shape)

    grad, hess = slopes()
    gains = [(_quarters(crossed(i, j, grad), crossed(i, j, hess))[0], i, j) for i, j in combinations(range(width), 2)]
    pairs = [[i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))] for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for pair in pairs:
            grad, hess = slopes()
            i, j, table = pair
            step = RATE * _quarters(crossed(i, j, grad), crossed(i, j, hess))[1]
            table += step
            total += step[cells[i], cells[j]]
    return Model(start, edges, tables, coarse, [tuple(p) for p in pairs])


def trained(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> Model:
    """A model from labelled rows, at most about `sample` of them.

    Null ids and null labels do not count. An id labelled more than once counts as
    1 if most of its labels are. Of rows with one id only one counts, that with the
    least hash of its text, so a repeated id adds neither rows nor weight. Null
    texts count as empty. Without labels, or with an empty table, the model is
    constant.
    """
    arrow_batches(documents.sparkSession)
    key = column(labels, id_col)
    marked = labels.select(key.alias("id"), column(labels, label_col).alias("label"))
    marked = marked.filter("id is not null and label is not null").groupBy("id")
    marked = marked.agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    share = min(1.0, 0.95 * sample / max(marked.count(), 1))
    drawn = F.pmod(F.xxhash64("id"), F.lit(_PARTS)) < int(share * _PARTS) + (share == 1.0)
    rows = keyed(documents, id_col, text_col).filter(drawn).withColumn("hash", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            x = features(utf8(batch.column("text")))
            found = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("hash"), found.cast(pa.list_(pa.float32()))], ["id", "hash", "x"]
            )

    found = rows.mapInArrow(run, f"id {kind}, hash bigint, x array<float>")
    found = found.groupBy("id").agg(F.min(F.struct("hash", "x")).alias("least"))
    found = found.select("id", "least.x").join(marked.filter(drawn), "id")
    got = sorted((r["id"], tuple(r["x"]), r["label"]) for r in found.collect())
    x = np.array([r[1] for r in got], np.float32).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[2] for r in got], np.float64))


def scored(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) for every row; null texts count as empty, and empty ones get a score."""
    arrow_batches(documents.sparkSession)
    rows = keyed(documents, id_col, text_col)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = sent.value.scores(features(utf8(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score)], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def accepted(documents: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose text scores `least` or more, whole.

    A null text counts as empty and is kept or not by the score of that. Rows with
    null or repeated ids are judged each by its own text. An empty table stays empty.
    """
    arrow_batches(documents.sparkSession)
    rows = packed(documents, text_col)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = sent.value.scores(features(utf8(batch.column("text"))))
            yield batch.filter(pa.array(score >= least))

    return rows.mapInArrow(run, rows.schema).select("row.*")
