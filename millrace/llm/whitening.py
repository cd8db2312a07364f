"""Whitening of vectors by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers, so that distinct vectors, sums and products are
exact and do not depend on how rows are dealt out. Spark makes vectors distinct
(equal ones meet in each task before they travel), then adds up sums, and products
of centred entries: each task sends one number for each pair of dimensions.

The scatter matrix has as many rows as vectors have dimensions, whatever the
number of vectors. It is factored into P L L' P' by Cholesky, taking the largest
remaining diagonal entry first, which shows the rank. One-sided Jacobi turns the
columns of L until they are orthogonal: their squared lengths are the
eigenvalues, and the columns of unit length the components. The product L L' is
not formed again, so small eigenvalues keep their digits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import arrow_batches, column, write_once

SCALE = 256
# Rows a task adds up at a time.
BLOCK = 8192
_EXACT = 1 << 53
_LONG = 1 << 63
# Whole numbers go no further, so that sums of products fit 38 digits. Beyond 2^32
# no deviation fits 64 bits anyway.
_FARTHEST = float(1 << 46)


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with matrix[order][:, order] = L L', L having as many columns as the rank."""
    a = np.array(matrix, float)
    d = len(a)
    order, left = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        rest = a.diagonal()[k:]
        p = k + int(np.argmax(rest))
        if a[p, p] <= least:
            return left[:, :k], order
        if p != k:
            for x in (a, left):
                x[[k, p]] = x[[p, k]]
            a[:, [k, p]] = a[:, [p, k]]
            order[[k, p]] = order[[p, k]]
        left[k:, k] = a[k:, k] / math.sqrt(a[k, k])
        a[k + 1 :, k + 1 :] -= np.outer(left[k + 1 :, k], left[k + 1 :, k])
    return left, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """`factor` with its columns turned, two by two, until all are orthogonal.

    Rounds take disjoint pairs, as in a tournament, so each is a few operations on
    whole matrices.
    """
    g = np.array(factor, float)
    r = g.shape[1]
    if r < 2:
        return g
    players = np.arange(r + r % 2)
    tolerance = len(g) * np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(players) - 1):
            half = len(players) // 2
            i, j = players[:half], players[half:][::-1]
            both = (i < r) & (j < r)
            i, j = np.minimum(i, j)[both], np.maximum(i, j)[both]
            x, y = g[:, i], g[:, j]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha * beta)
            cosine = np.divide(np.abs(gamma), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > tolerance
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.hypot(1.0, t)
            g[:, i], g[:, j] = c * (x - t * y), c * (y + t * x)
            players = np.concatenate((players[:1], players[-1:], players[1:-1]))
        if worst <= tolerance:
            break
    return g


def principal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues, falling, and their unit eigenvectors as columns.

    Of the two signs the one whose largest entry is positive.
    """
    factor, order = pivoted_cholesky(matrix)
    turned = np.empty_like(factor)
    turned[order] = one_sided_jacobi(factor)
    lengths = np.sqrt((turned * turned).sum(0))
    falling = np.argsort(-lengths, kind="stable")
    falling = falling[lengths[falling] > 0]
    vectors = turned[:, falling] / lengths[falling]
    largest = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(vectors.shape[1])]
    return lengths[falling] ** 2, vectors * np.sign(largest)


@dataclass
class Model:
    """What whitens a vector: `n` distinct vectors with sums `total`, and the components."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Centred rows of `x` on each component, over the root of its eigenvalue."""
        # The whole part of the mean comes off exactly, before anything is rounded.
        whole = np.array([t // self.n for t in self.total], np.int64)
        part = np.array([float(Fraction(t % self.n, self.n)) for t in self.total])
        centred = (x - whole).astype(float) - part
        return centred @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - total)^2; None beyond 64 bits."""
        most = max(int(np.abs(x).max(initial=0)), 1)
        far = self.n * most + max(map(abs, self.total))
        if len(self.total) * far * far < _LONG:
            y = self.n * x - np.array(self.total, np.int64)
            return (y * y).sum(1).tolist()
        y = self.n * x.astype(object) - np.array(self.total, object)
        return [s if s < _LONG else None for s in (y * y).sum(1)]


def _matrix(values, d: int) -> np.ndarray:
    """An Arrow list column whose lists have d entries."""
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> dict[int, int]:
    """Exact sums by dimension, and the number of rows as number -1."""

    def run(batches):
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            most = max(int(np.abs(x).max(initial=0)), 1)
            exact = x if most * len(x) < _LONG else x.astype(object)
            n, total = n + len(x), total + exact.sum(0).astype(object)
        yield _numbers([(-1, -1, n), *((i, -1, t) for i, t in enumerate(total))])

    found = fit.mapInArrow(run, _NUMBERS).groupBy("i").agg(F.sum("v").alias("v"))
    return {r["i"]: int(r["v"]) for r in found.collect()}


_NUMBERS = "i int, j int, v decimal(38,0)"


def _numbers(rows: list[tuple]) -> pa.RecordBatch:
    i, j, v = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([int(x) for x in v], pa.decimal128(38, 0))],
        ["i", "j", "v"],
    )


def _products(x: np.ndarray) -> np.ndarray:
    """Exact x' x as Python integers."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    rows = _EXACT // (most * most)
    if not rows:
        x = x.astype(object)
        return x.T @ x
    out = np.zeros((x.shape[1],) * 2, object)
    for a in range(0, len(x), min(rows, BLOCK)):
        part = x[a : a + min(rows, BLOCK)].astype(float)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def _scatter(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """n^2 times the covariance, exactly, as Python integers.

    Entries are centred by the whole number nearest to the mean and then
    multiplied; what is left of the mean, less than one half, is taken off the sums.
    """
    d = len(total)
    centre = [(2 * t + n) // (2 * n) for t in total]
    shift = np.array(centre, np.int64)

    def run(batches):
        held = np.zeros((d, d), object)
        for batch in batches:
            held += _products(_matrix(batch.column("x"), d) - shift)
        yield _numbers([(i, j, held[i, j]) for i in range(d) for j in range(i + 1)])

    found = fit.mapInArrow(run, _NUMBERS).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((d, d), object)
    rest = [t - n * c for t, c in zip(total, centre)]
    for r in found.collect():
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = n * int(r["v"]) - rest[i] * rest[j]
    return out


def _identity_error(fit: DataFrame, model: Model) -> float:
    """Largest entry of the covariance of the whitened fit list, less the identity.

    Sums are of decimals, so they do not depend on the order of tasks.
    """
    k, d = len(model.values), len(model.total)
    if not k:
        return 0.0

    def run(batches):
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = model.whitened(_matrix(batch.column("x"), d))
            sums, products = sums + w.sum(0), products + w.T @ w
        rows = [(i, -1, s) for i, s in enumerate(sums)]
        rows += [(i, j, products[i, j]) for i in range(k) for j in range(i + 1)]
        i, j, v = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v, pa.float64())], ["i", "j", "v"]
        )

    found = fit.mapInArrow(run, "i int, j int, v double").groupBy("i", "j")
    found = found.agg(F.sum(F.col("v").cast("decimal(38,18)")).cast("double").alias("v"))
    sums = {(r["i"], r["j"]): r["v"] / model.n for r in found.collect()}
    entries = [
        abs(sums[i, j] - sums[i, -1] * sums[j, -1] - (i == j)) for i in range(k) for j in range(i + 1)
    ]
    return max(entries)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id, x: entries as whole numbers floor(scale * entry); vectors that hold no number go.

    Whole numbers beyond 2^46, either way, become that.
    """
    entries = column(vectors, vector_col).cast("array<double>")
    rows = vectors.select(column(vectors, id_col).alias("id"), entries.alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    near = lambda c: F.least(F.greatest(c, F.lit(-_FARTHEST)), F.lit(_FARTHEST))
    x = F.transform("v", lambda c: F.floor(near(c * float(scale))).cast("bigint"))
    return rows.filter(F.col("v").isNotNull() & ~odd & (F.size("v") > 0)).select("id", x.alias("x"))


def fitted(rows: DataFrame, components: int | None = None) -> Model | None:
    """A model of the distinct vectors x of `rows`; None if there are none.

    Vectors of the commonest length count (of several, the longest). Components
    without variance are left out.
    """
    arrow_batches(rows.sparkSession, 4096)
    fit = write_once(rows.select("x").distinct(), "vectors")
    lengths = fit.groupBy(F.size("x").alias("d")).count()
    first = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if first is None:
        return None
    d = first["d"]
    fit = fit.filter(F.size("x") == d)
    sums = _sums(fit, d)
    n, total = sums[-1], [sums[i] for i in range(d)]
    scatter = _scatter(fit, n, total)
    # Each entry is rounded once.
    matrix = np.array([[float(Fraction(x, n * n)) for x in row] for row in scatter])
    trace = float(Fraction(sum(scatter[i, i] for i in range(d)), n * n))
    values, vectors = principal(matrix)
    model = Model(n, total, values[:components], vectors[:, :components], trace)
    model.identity_error = _identity_error(fit, model)
    return model


def whitened(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int | None = None,
    scale: int = SCALE,
) -> DataFrame:
    """id, n, deviation, whitened, explained, identity_error, for every row that has a vector.

    `whitened` and `explained` are lists, by falling eigenvalue, of at most
    `components` numbers. Null vectors and such with null or non-finite entries give no
    row; nor do empty ones and those of another length than most. Repeated rows and
    null ids each get a row, but equal vectors count once in the fit. Where all
    vectors are equal there is no component and the lists are empty. Of equal
    eigenvalues any orthogonal components are right. An empty table gives no rows.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>,"
        " identity_error double"
    )
    model = fitted(rows, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        k, share = len(model.values), (model.values / model.trace).tolist()
        for batch in batches:
            x = _matrix(batch.column("x"), len(model.total))
            edges = pa.array(np.arange(len(x) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(np.full(len(x), model.n)),
                    pa.array(model.deviations(x), pa.int64()),
                    pa.ListArray.from_arrays(edges, pa.array(model.whitened(x).ravel())),
                    pa.ListArray.from_arrays(edges, pa.array(share * len(x), pa.float64())),
                    pa.array(np.full(len(x), model.identity_error)),
                ],
                ["id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.filter(F.size("x") == len(model.total)).mapInArrow(run, schema)
