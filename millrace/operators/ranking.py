"""The first rows of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Spark cuts groups below the shuffle up to this many rows (its own default of
# spark.sql.optimizer.windowGroupLimitThreshold).
PUSHED_ROWS = 1000
PARTS = 64
_PART = "part_of_group"


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], rows: int, rank: str = "rank"
) -> DataFrame:
    """The first `rows` rows of each group, numbered from 1.

    `order` must tell all rows of a group apart. Up to 1,000 rows Spark pushes the
    filter on the row number below the shuffle, so each task sends at most `rows`
    rows of a group. For more, rows are first numbered within parts of groups, at
    least as many as there are shuffle partitions, and only what is first in its
    part meets the rest of its group.
    """
    if rows > PUSHED_ROWS:
        parts = max(PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        part = F.pmod(F.xxhash64(*df.columns), F.lit(parts))
        in_part = Window.partitionBy(*keys, _PART).orderBy(*order)
        df = df.withColumn(_PART, part).withColumn(rank, F.row_number().over(in_part))
        df = df.where(F.col(rank) <= rows).drop(_PART, rank)
    ordered = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(ordered)).where(F.col(rank) <= rows)
