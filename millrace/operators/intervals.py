"""Joins on equal keys and times within an interval of each other.

`interval_pairs` gives the matching pairs. `interval_totals` gives, per left
row, totals over its matches without forming a single pair; its cost is linear
in the rows however densely they match, so it is the one to use for counts and
sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import bucket_start, micros
from ..sources.scratch import write_once
from .hot_groups import hot_groups, rows_in, rows_not_in
from .running import totals_over_segments
from .segments import in_segments

_AT = "at_micros"
_SIDE = "side"
_ID = "row_id"
_ROW = "left_row"
_NUMBER = "row_number_given"
_BUCKET = "time_bucket"

_BEFORE_MATCHES, _MATCHES, _AFTER_MATCHES = 0, 1, 2


def interval_totals(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    before: float,
    after: float,
    measures: dict[str, Column],
) -> DataFrame:
    """Add to each left row the totals of the right rows it matches.

    A right row matches when its keys are equal and its time is from `before`
    seconds before the left row's time to `after` seconds after it, both ends
    included. Measures are whole-number expressions on `right`; a left row with
    no match gets 0.
    """
    right = right.dropna(subset=[*keys, right_time])
    row_type = left.schema
    asked = left.select(
        *keys,
        F.unix_micros(left_time).alias(_AT),
        F.struct(*left.columns).alias(_ROW),
        *[F.lit(0).cast("bigint").alias(name) for name in measures],
    )
    offered = right.select(
        *keys,
        F.unix_micros(right_time).alias(_AT),
        F.lit(None).cast(row_type).alias(_ROW),
        *[F.coalesce(m, F.lit(0)).cast("bigint").alias(name) for name, m in measures.items()],
    )
    both = asked.unionByName(offered)
    hot = hot_groups(both, keys)
    ordinary = both if hot is None else rows_not_in(both, hot, keys)

    # Both frames start at the first row, so Spark extends them row by row; a
    # frame with two moving ends would be added up anew for every row.
    in_time = Window.partitionBy(*keys).orderBy(_AT)
    through_end = in_time.rangeBetween(Window.unboundedPreceding, micros(after))
    before_start = in_time.rangeBetween(Window.unboundedPreceding, -micros(before) - 1)
    result = (
        ordinary.select(
            _ROW,
            *[
                (
                    F.sum(name).over(through_end)
                    - F.coalesce(F.sum(name).over(before_start), F.lit(0))
                ).alias(name)
                for name in measures
            ],
        )
        .where(F.col(_ROW).isNotNull())
        .select(f"{_ROW}.*", *measures)
    )
    if hot is None:
        return result
    return result.unionByName(
        totals_between_marks(
            rows_in(left, hot, keys),
            rows_in(right, hot, keys),
            keys, left_time, right_time, right_id, before, after, measures, 2 * hot.rows,
        )
    )


def totals_between_marks(
    left, right, keys, left_time, right_time, right_id, before, after, measures, rows
) -> DataFrame:
    """`interval_totals` for hot groups, in which null keys match as well.

    Each left row sets two marks among the right rows, at the two ends of its
    interval. Its total is the running total at the second less that at the
    first, and running totals can be taken over a group cut into segments. The
    marks carry a number that the row is given, as ids may repeat; the row itself is
    joined on at the end. There are about `rows` marks and right rows in all.
    """
    at = F.unix_micros(left_time)
    left = write_once(left.withColumn(_NUMBER, F.monotonically_increasing_id()), "numbered")
    marks = left.select(
        *keys,
        F.col(_NUMBER).alias(_ID),
        F.explode(
            F.array(
                F.struct((at - micros(before)).alias(_AT), F.lit(_BEFORE_MATCHES).alias(_SIDE)),
                F.struct((at + micros(after)).alias(_AT), F.lit(_AFTER_MATCHES).alias(_SIDE)),
            )
        ).alias("mark"),
    ).select(*keys, _ID, "mark.*", *[F.lit(0).cast("bigint").alias(name) for name in measures])
    values = right.select(
        *keys,
        # Only to cut rows of one time evenly.
        F.xxhash64(right_id).alias(_ID),
        F.unix_micros(right_time).alias(_AT),
        F.lit(_MATCHES).alias(_SIDE),
        *[F.coalesce(m, F.lit(0)).cast("bigint").alias(name) for name, m in measures.items()],
    )
    totals = {f"{name}_to_here": F.col(name) for name in measures}
    order = [_AT, _SIDE, _ID]
    segmented = in_segments(marks.unionByName(values), keys, order, rows)
    running = totals_over_segments(segmented, keys, order, totals)
    sign = F.when(F.col(_SIDE) == _AFTER_MATCHES, 1).otherwise(-1)
    between = (
        running.where(F.col(_SIDE) != _MATCHES)
        .groupBy(_ID)
        .agg(*[F.sum(sign * F.col(f"{name}_to_here")).alias(name) for name in measures])
    )
    return left.join(between, F.col(_NUMBER) == F.col(_ID)).drop(_ID, _NUMBER)


def in_bucket(df: DataFrame, time: str, width: int) -> DataFrame:
    """Add the start of the time bucket, `width` microseconds long, of each row."""
    return df.withColumn(_BUCKET, bucket_start(F.unix_micros(time), width))


def in_buckets_reached(
    df: DataFrame, time: str, width: int, before: float, after: float
) -> DataFrame:
    """Repeat each row for every bucket its interval reaches into: two of them
    when the width is the interval's length."""
    first = bucket_start(F.unix_micros(time) - micros(before), width)
    last = bucket_start(F.unix_micros(time) + micros(after), width)
    return df.withColumn(_BUCKET, F.explode(F.sequence(first, last, F.lit(width).cast("bigint"))))


def times_match(left_time: str, right_time: str, before: float, after: float) -> Column:
    distance = F.unix_micros(right_time) - F.unix_micros(left_time)
    return distance.between(-micros(before), micros(after))


def interval_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    left_id: str,
    right_id: str,
    before: float,
    after: float,
) -> DataFrame:
    """All pairs of a left and a right row that match as in `interval_totals`.

    The sides are joined on the keys and a time bucket as long as the interval,
    so rows are only compared with rows near them in time. A bucket that holds
    many rows is split at run time, by adaptive execution, which meets each part
    of one side with the whole bucket of the other. Apart from the keys, column
    names must differ.
    """
    width = max(micros(before + after), 1)
    left = in_buckets_reached(left.dropna(subset=keys), left_time, width, before, after)
    right = in_bucket(right.dropna(subset=keys), right_time, width)
    pairs = left.join(right, [*keys, _BUCKET])
    return pairs.where(times_match(left_time, right_time, before, after)).drop(_BUCKET)
