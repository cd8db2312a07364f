"""Rollups, cubes and chosen grouping sets over totals.

Spark expands each input row once per grouping set before it adds anything up.
Here rows are first added up at the finest grain, and only those few totals are
expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LEVEL = "level"


def rollup_totals(
    df: DataFrame, keys: list[str], finest: list[Column], coarser: list[Column]
) -> DataFrame:
    """Totals for each prefix of `keys`, down to the grand total.

    `finest` are aggregates over rows; `coarser` aggregate the columns those
    give. `level` tells, one bit per key, which keys are rolled up.
    """
    base = df.groupBy(*keys).agg(*finest)
    return base.rollup(*keys).agg(*coarser, F.grouping_id().alias(LEVEL))


def cube_totals(
    df: DataFrame, keys: list[str], finest: list[Column], coarser: list[Column]
) -> DataFrame:
    """Totals for each subset of `keys`; arguments as in `rollup_totals`."""
    base = df.groupBy(*keys).agg(*finest)
    return base.cube(*keys).agg(*coarser, F.grouping_id().alias(LEVEL))


def grouping_set_totals(
    df: DataFrame,
    keys: list[str],
    sets: list[list[str]],
    finest: list[Column],
    coarser: list[Column],
) -> DataFrame:
    """Totals for the named subsets of `keys`; arguments as in `rollup_totals`."""
    base = df.groupBy(*keys).agg(*finest)
    columns = [[F.col(k) for k in s] for s in sets]
    return base.groupingSets(columns, *[F.col(k) for k in keys]).agg(
        *coarser, F.grouping_id().alias(LEVEL)
    )
