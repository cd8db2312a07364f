"""Ordered work on groups too large for one task.

The rows of hot groups are range-partitioned on (keys, order). The order ends in
a unique column, so even a group whose rows all share one timestamp is cut into
even segments. Each segment is then worked on by itself, and what it needs to
know of earlier segments of its group is worked out from one summary row per
segment.

The segmented rows are written to shared storage once: the summaries and the
rows must see the same cut, also after executors are lost.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import write_once
from .hot_groups import hot_groups, rows_in, rows_not_in, rows_per_task

SEGMENT = "segment"


def in_segments(df: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """The rows of hot groups, about `rows` of them in all, each with its segment.

    Range partitions are numbered in the order of their rows. Adaptive execution
    leaves them as they are, since their number is given.
    """
    segments = ceil(rows / rows_per_task(df.sparkSession))
    cut = df.repartitionByRange(segments, *keys, *order).withColumn(
        SEGMENT, F.spark_partition_id()
    )
    return write_once(cut, "segments")


def split_ordered(
    df: DataFrame, keys: list[str], order: list[str]
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary groups, and rows of hot groups in segments.

    The second is None when no group is hot.
    """
    hot = hot_groups(df, keys)
    if hot is None:
        return df, None
    return rows_not_in(df, hot, keys), in_segments(rows_in(df, hot, keys), keys, order, hot.rows)


def within_segment(keys: list[str], order: list[str]):
    """The window from the start of a row's segment to the row."""
    return (
        Window.partitionBy(*keys, SEGMENT)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def with_earlier_segments(
    rows: DataFrame,
    keys: list[str],
    summaries: dict[str, tuple[Column, Callable[[Column], Column]]],
) -> DataFrame:
    """Add to each row what the earlier segments of its group come to.

    Each summary is an aggregate over one segment and the function that folds
    the aggregates of all earlier segments. It is null in a group's first one.
    """
    per_segment = rows.groupBy(*keys, SEGMENT).agg(
        *[aggregate.alias(name) for name, (aggregate, _) in summaries.items()]
    )
    before = (
        Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    )
    cut_by = [*keys, SEGMENT]
    earlier = per_segment.select(
        *[F.col(c).alias(f"of_{c}") for c in cut_by],
        *[fold(F.col(name)).over(before).alias(name) for name, (_, fold) in summaries.items()],
    )
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in cut_by]
    # One row per group and segment, but maybe a wide one: Spark chooses the join.
    return rows.join(earlier, same).drop(*[f"of_{c}" for c in cut_by])
