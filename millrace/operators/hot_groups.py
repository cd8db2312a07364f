"""Finding the few groups too large for one task.

Operators that need a whole group in order (windows, as-of lookups) or that
meet every row of one group with every row of another (interval joins) first
estimate rows per group. Groups small enough for one task take the ordinary plan;
the rest are split.

The estimate only decides how the work is divided. All rows are worked on either
way, so results do not depend on it. It reads the key columns and counts a sample
of them, because a full count by a key with very many values would shuffle about
as much as the work itself.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.scratch import write_once

# A group with more rows than this is split. A task sorts that many narrow rows
# in about half a minute, and for smaller groups the split costs more than it saves.
ROWS_PER_TASK_SETTING = "spark.millrace.rowsPerTask"
ROWS_PER_TASK = 20_000_000

# A group at the limit is expected to have this many rows in the sample, which
# makes its estimate right to about 3 %. Below such a limit all rows are counted.
SAMPLED_ROWS = 1_000

GROUP_ROWS = "group_rows"


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equality on all keys in which null equals null, as in grouping."""
    return reduce(Column.__and__, [left[k].eqNullSafe(right[k]) for k in keys])


def rows_per_task(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_TASK_SETTING, str(ROWS_PER_TASK)))


class HotGroups(NamedTuple):
    """The groups to be split, as a table, and the sum of their estimated rows."""

    keys: DataFrame
    rows: int


def hot_groups(df: DataFrame, keys: list[str], most: int | None = None) -> HotGroups | None:
    """The groups with more than `most` rows, by default as many as one task
    should take.

    The groups stay in a table, however many there are; only the sum of their
    rows comes to the driver. Returns None when there are none, so that callers
    can leave the split out of the plan altogether; then nothing is written.
    """
    most = most or rows_per_task(df.sparkSession)
    share = min(1.0, SAMPLED_ROWS / most)
    counted = df.select(*keys)
    if share < 1:
        counted = counted.sample(share, seed=1)
    estimates = counted.groupBy(*keys).agg(
        F.round(F.count(F.lit(1)) / share).cast("bigint").alias(GROUP_ROWS)
    )
    listed = estimates.where(F.col(GROUP_ROWS) > most)
    rows = listed.agg(F.sum(GROUP_ROWS)).first()[0]
    return None if rows is None else HotGroups(write_once(listed, "hot-groups"), rows)


def rows_in(df: DataFrame, hot: HotGroups, keys: list[str]) -> DataFrame:
    """Rows of `df` that belong to a hot group. Spark broadcasts the groups if they are few."""
    return df.join(hot.keys, same_keys(df, hot.keys, keys), "left_semi")


def rows_not_in(df: DataFrame, hot: HotGroups, keys: list[str]) -> DataFrame:
    """Rows of `df` that belong to no hot group."""
    return df.join(hot.keys, same_keys(df, hot.keys, keys), "left_anti")
