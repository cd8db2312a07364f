"""Whitening: against numpy's eigenvectors and exact sums."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm.queries import op12_whitening
from millrace.llm.whitening import fitted, one_sided_jacobi, pivoted_cholesky, principal, quantised, whitened

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(vectors, scale=256):
    x = np.array([[math.floor(scale * float(np.float32(c))) for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(v) for v in x}), object)
    n, total = len(fit), fit.sum(0)
    centred = (n * fit - total).astype(float) / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    return n, x, total, values[::-1], parts[:, ::-1]


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 9), st.integers(1, 12), st.integers(0, 2**32 - 1))
def test_components_of_any_matrix(d, rank, seed):
    part = np.random.default_rng(seed).normal(size=(d, rank)) * np.logspace(0, -3, rank)
    matrix = part @ part.T
    factor, order = pivoted_cholesky(matrix)
    assert np.allclose(factor @ factor.T, matrix[np.ix_(order, order)], atol=1e-12)
    turned = one_sided_jacobi(factor)
    gram = turned.T @ turned
    assert np.abs(gram - np.diag(gram.diagonal())).max(initial=0) < 1e-10
    values, vectors = principal(matrix)
    want = np.linalg.eigvalsh(matrix)[::-1]
    assert np.allclose(values, want[: len(values)], rtol=1e-9, atol=1e-13)
    assert np.allclose(want[len(values) :], 0, atol=1e-12)
    assert np.allclose(matrix @ vectors, vectors * values, atol=1e-10)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-10)


def test_small_eigenvalues_keep_their_digits():
    scale = np.diag(10.0 ** -np.arange(0, 12, 2))
    matrix = scale @ (np.eye(6) + 0.3) @ scale
    exact = principal(matrix)[0]
    assert np.allclose(np.prod(exact), np.prod(scale.diagonal() ** 2) * np.linalg.det(np.eye(6) + 0.3), rtol=1e-10)


def test_like_brute_force(spark, frame, rng):
    base = [[rng.gauss(0, 1 + i) for i in range(6)] for _ in range(300)]
    # A third of all rows is one vector; repeated ids and null ids stay rows.
    rows = [(i, v, 1) for i, v in enumerate(base)] + [(7, base[0], 2)] * 150 + [(None, base[1], 3)]
    odd = [(900, None, 1), (901, [], 1), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (903, [float("nan")] * 6, 1)]
    odd += [(904, [float("inf")] + [0.0] * 5, 1), (905, [1.0, 2.0], 1)]
    got = whitened(frame(rows + odd, SCHEMA, 7)).toPandas()
    assert len(got) == len(rows)
    n, x, total, values, parts = brute([v for _, v, _ in rows])
    assert set(got.n) == {n} == {300}
    model = fitted(quantised(frame(rows, SCHEMA, 3), "vec_id", "embedding"))
    assert np.allclose(model.values, values, rtol=1e-12) and np.allclose(model.trace, values.sum(), rtol=1e-12)
    expected = {i: [] for i in [*range(300), None]}
    for (i, _, _), v in zip(rows, x):
        y = n * v - total
        expected[i].append((int((y * y).sum()), np.abs((y.astype(float) / n) @ parts / np.sqrt(values))))
    for r in got.itertuples():
        deviation, numbers = expected[None if math.isnan(r.id) else int(r.id)][0 if r.id != 7 or r.deviation == expected[7][0][0] else 1]
        assert r.deviation == deviation and np.allclose(np.abs(r.whitened), numbers, rtol=1e-9, atol=1e-9)
        assert np.allclose(r.explained, values / values.sum(), rtol=1e-12)
    assert 0 <= got.identity_error.iloc[0] < 1e-9 and got.identity_error.nunique() == 1


def test_does_not_depend_on_how_rows_are_dealt(spark, frame, rng):
    rows = [(i, [rng.gauss(0, 3) for _ in range(5)], 0) for i in range(200)]
    one, many = (whitened(frame(r, SCHEMA, p)).toPandas().sort_values("id") for r, p in ((rows, 1), (rows[::-1], 9)))
    assert one.whitened.map(tuple).tolist() == many.whitened.map(tuple).tolist()
    assert one.deviation.tolist() == many.deviation.tolist()


def test_equal_vectors_and_none(spark, frame):
    same = whitened(frame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], SCHEMA)).toPandas()
    assert list(same.deviation) == [0, 0] and list(same.n) == [1, 1] and [len(w) for w in same.whitened] == [0, 0]
    for rows in ([], [(1, None, 0)]):
        assert whitened(frame(rows, SCHEMA)).count() == 0


def test_large_entries(spark, frame):
    rows = [(1, [3e30, 1.0], 0), (2, [-3e30, 2.0], 0), (3, [5e6, 0.5], 0)]
    got = {r.id: r for r in whitened(frame(rows, SCHEMA)).collect()}
    assert got[1].deviation is None and all(math.isfinite(w) for r in got.values() for w in r.whitened)


def test_clashing_columns(spark, frame):
    df = frame([(i, [float(i), float(i * i)], i, i) for i in range(9)], "vec_id int, embedding array<double>, id int, x int")
    assert sorted(r.id for r in whitened(df).collect()) == list(range(9))


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    got = op12_whitening(spark, folder).toPandas()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    n, x, total, values, parts = brute(table.embedding)
    assert len(got) == 4 * len(table) and set(got.n) == {n} and set(got.component) == {1, 2, 3, 4}
    at = {i: k for k, i in enumerate(table.vec_id)}
    y = n * x[[at[i] for i in got.vec_id]] - total
    assert [int(d) for d in (y * y).sum(1)] == got.deviation.tolist()
    c = got.component.to_numpy() - 1
    want = ((y.astype(float) / n) * parts[:, c].T).sum(1) / np.sqrt(values[c])
    signs = np.sign(want * got.whitened)
    assert np.allclose(np.abs(want), np.abs(got.whitened), atol=1e-8)
    assert all(len(set(signs[(c == k) & (np.abs(want) > 1e-6)])) == 1 for k in range(4))
    assert np.allclose(got.explained, (values / values.sum())[c], rtol=1e-10)
    assert got.identity_error.max() < 1e-9
