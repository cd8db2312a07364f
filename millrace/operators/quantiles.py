"""Exact quantiles of groups of any size, without sorting the groups.

A sketch of fixed size per group says between which two values a quantile is
likely to be. A second scan counts what is below and within; if the rank asked for
is within, only those rows matter from then on, a few hundredths of the group. This
is repeated until a group's rows within the bounds are few enough for one task,
which then sorts them. Where a sketch was wrong, the old bounds stay and wider ones
are tried, so the result is exact in any case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.scratch import write_once
from .hot_groups import rows_per_task, same_keys

SKETCH = 400
# How far from the rank asked for the bounds are taken, as a share of the rows.
MARGIN = 0.02
STEPS = 100
ROUNDS = 12


def quantiles(
    df: DataFrame, keys: list[str], value: str, thousandths: list[int], most: int | None = None
) -> DataFrame:
    """keys, thousandth, n_rows and the value of that rank, for each group and each of `thousandths`.

    The value at k thousandths is the least one that at least so many of the group's
    rows do not exceed; at 0 the least of all. `value` is a whole number; nulls do not
    count, and groups without values have no rows. Null is a key like any other.
    """
    if any(not 0 <= k <= 1000 for k in thousandths):
        raise ValueError("thousandths are from 0 to 1000")
    most = most or rows_per_task(df.sparkSession)
    rows = df.select(*keys, F.col(value).cast("bigint").alias("value")).where("value is not null")
    asked = F.explode(F.array(*[F.lit(k) for k in sorted(set(thousandths))])).alias("thousandth")
    groups = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    rank = F.greatest(F.lit(1).cast("bigint"), F.expr("(n_rows * thousandth + 999) div 1000"))
    state = groups.select("*", asked).select(
        *keys, "thousandth", "n_rows", "low", "high",
        rank.alias("rank"), F.col("n_rows").alias("within"),
    )
    state = write_once(state, "quantiles")
    for turn in range(ROUNDS):
        large = (F.col("within") > most) & (F.col("low") < F.col("high"))
        wide = state.where(large)
        if wide.isEmpty():
            break
        closer = _narrowed(rows, wide, keys, MARGIN * 2**turn if turn < 5 else 1.0)
        state = write_once(state.where(~large).unionByName(closer), "quantiles")
    return _ranked(rows, state, keys)


def _inside(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Rows within the bounds of their groups, once for each quantile."""
    here = rows.select(*[F.col(k).alias(f"{k}_") for k in keys], "value")
    same = F.lit(True)
    for k in keys:
        same = same & here[f"{k}_"].eqNullSafe(state[k])
    within = (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high"))
    return state.join(here, same & within).drop(*[f"{k}_" for k in keys])


def _narrowed(rows: DataFrame, wide: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """The groups in `wide` with closer bounds."""
    own = [*keys, "thousandth"]
    rank = F.first("rank") / F.first("within")
    sketch = F.kll_sketch_agg_bigint("value", F.lit(SKETCH))
    found = _inside(rows, wide, keys).groupBy(*own).agg(sketch.alias("sketch"), rank.alias("at"))
    # A sketch is asked only at fixed ranks: the nearest of those on either side.
    fixed = F.array(*[F.lit(i / STEPS) for i in range(STEPS + 1)])
    found = found.withColumn("values", F.kll_sketch_get_quantile_bigint("sketch", fixed))
    place = lambda x: F.greatest(F.lit(0), F.least(F.lit(STEPS), x.cast("int")))
    near = found.select(
        *own,
        F.get("values", place(F.floor((F.col("at") - margin) * STEPS))).alias("new_low"),
        F.get("values", place(F.ceil((F.col("at") + margin) * STEPS))).alias("new_high"),
    )
    near = write_once(near, "quantiles")
    closer = wide.join(near, same_keys(wide, near, own)).select(wide["*"], "new_low", "new_high")
    below = F.count(F.when(F.col("value") < F.col("new_low"), 1)).alias("below")
    upto = F.count(F.when(F.col("value") <= F.col("new_high"), 1)).alias("upto")
    counted = _inside(rows, closer, keys).groupBy(*wide.columns, "new_low", "new_high").agg(below, upto)
    right = (F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("upto"))
    return counted.select(
        *own, "n_rows",
        F.when(right, F.col("new_low")).otherwise(F.col("low")).alias("low"),
        F.when(right, F.col("new_high")).otherwise(F.col("high")).alias("high"),
        F.when(right, F.col("rank") - F.col("below")).otherwise(F.col("rank")).alias("rank"),
        F.when(right, F.col("upto") - F.col("below")).otherwise(F.col("within")).alias("within"),
    )


def _ranked(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The value of each rank among the rows within the bounds."""
    own = [*keys, "thousandth"]
    done = state.where(F.col("low") == F.col("high")).select(*own, "n_rows", F.col("low").alias("value"))
    inside = _inside(rows, state.where(F.col("low") < F.col("high")), keys)
    # Equal values are counted before they are sorted.
    counted = inside.groupBy(*own, "n_rows", "rank", "value").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy(*own).orderBy("value")
    upto = F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("upto", upto)
    here = (F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("copies") < F.col("rank"))
    return done.unionByName(ranked.where(here).select(*own, "n_rows", "value"))
