"""Sketches as a means to exact results: quantiles and frequent keys."""

from collections import Counter

import pytest

from millrace.operators import quantiles as module
from millrace.operators.frequent import frequent_keys
from millrace.operators.quantiles import quantiles

RANKS = [0, 1, 250, 333, 500, 999, 1000]


def brute(rows, ranks):
    groups = {}
    for key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append(value)
    out = []
    for key, values in groups.items():
        values.sort()
        out += [(key, k, len(values), values[max(1, (len(values) * k + 999) // 1000) - 1]) for k in set(ranks)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def skewed():
    """One key has a third of the rows, and another third has none; many ties and some nulls."""
    import random

    rng = random.Random(11)
    rows = [(rng.choice(["hot", None, f"k{rng.randrange(4)}"]), int(rng.paretovariate(0.7) * 10)) for _ in range(9000)]
    rows += [("same", 5)] * 700 + [("wide", rng.choice([-(2**62), 2**62, 0, 1])) for _ in range(600)]
    return rows + [("hot", None)] * 100 + [("none", None)] * 3 + [("one", 7)]


@pytest.mark.parametrize("most", [None, 400, 30, 1])
def test_quantiles_are_exact_however_groups_are_narrowed(spark, skewed, most):
    df = spark.createDataFrame(skewed, "key string, value bigint").repartition(5)
    assert got(quantiles(df, ["key"], "value", RANKS, most)) == brute(skewed, RANKS)


def test_quantiles_are_exact_where_sketches_are_wrong(spark, skewed, monkeypatch):
    """Bounds that miss the rank are not taken."""
    monkeypatch.setattr(module, "SKETCH", 8)
    monkeypatch.setattr(module, "MARGIN", 0.0)
    df = spark.createDataFrame(skewed, "key string, value bigint")
    assert got(quantiles(df, ["key"], "value", [100, 900], 20)) == brute(skewed, [100, 900])


def test_quantiles_of_no_rows_and_no_keys(spark, skewed):
    empty = spark.createDataFrame([], "key string, value bigint")
    assert got(quantiles(empty, ["key"], "value", RANKS)) == []
    df = spark.createDataFrame(skewed, "key string, value bigint").select("value")
    want = [r[1:] for r in brute([(0, v) for _, v in skewed], [500])]
    assert got(quantiles(df, [], "value", [500], 100)) == want
    with pytest.raises(ValueError):
        quantiles(empty, ["key"], "value", [1001])


@pytest.mark.parametrize("share", [0.0002, 0.01, 0.2, 1.0])
@pytest.mark.parametrize("parts", [1, 9])
def test_frequent_keys_are_all_above_the_share(spark, share, parts):
    """Whatever the order of rows: a third is one key, a third has none, the rest are all different."""
    rows = [(("a", None, f"k{i}")[i % 3], i % 2) for i in range(6000)]
    rows = sorted(rows, key=repr) + [("edge", 1)] * 60
    df = spark.createDataFrame(rows, "key string, bit int").repartition(parts) if parts > 1 else spark.createDataFrame(rows, "key string, bit int").coalesce(1)
    want = [(*k, n) for k, n in Counter(rows).items() if n >= share * len(rows)]
    assert got(frequent_keys(df, ["key", "bit"], share)) == sorted(want, key=repr)


def test_frequent_keys_at_the_edges(spark):
    empty = spark.createDataFrame([], "key string")
    assert got(frequent_keys(empty, ["key"], 0.5)) == []
    df = spark.createDataFrame([("x",)] * 5 + [("y",)] * 5, "key string")
    assert got(frequent_keys(df, ["key"], 0.5)) == [("x", 5), ("y", 5)] and got(frequent_keys(df, ["key"], 0.51)) == []
    with pytest.raises(ValueError):
        frequent_keys(df, ["key"], 0.0)


def test_plan_of_frequent_keys(spark):
    df = spark.createDataFrame([("x",)], "key string")
    plan = frequent_keys(df, ["key"], 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "Python" not in plan
