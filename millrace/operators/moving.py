"""Moving totals: over the last rows, or over the last stretch of time.

Both are the difference of two totals that start at the group's first row. Spark
extends such totals row by row, whereas a frame with two moving ends is added up
anew for every row, at a cost that grows with the frame. Measures are whole
numbers; nulls are passed over, and the total of a frame without a value is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import micros
from .hot_groups import hot_groups, rows_in, rows_not_in
from .intervals import totals_between_marks
from .running import totals_over_segments
from .segments import in_segments

_PLACE = "place_in_group"
_ROW = "whole_row"
_VALUES = "_values_in_frame"


def _difference(measure: Column, through_row, before_frame) -> Column:
    values = F.count(measure).over(through_row) - F.count(measure).over(before_frame)
    total = F.sum(measure).over(through_row) - F.coalesce(
        F.sum(measure).over(before_frame), F.lit(0)
    )
    return F.when(values > 0, total)


def _with_counts(measures: dict[str, Column]) -> dict[str, Column]:
    """The measures with 0 for null, and how many values each has."""
    sums = {n: F.coalesce(m, F.lit(0)) for n, m in measures.items()}
    return sums | {f"{n}{_VALUES}": m.isNotNull().cast("bigint") for n, m in measures.items()}


def _null_without_values(measures: dict[str, Column]) -> list[Column]:
    return [F.when(F.col(f"{n}{_VALUES}") > 0, F.col(n)).alias(n) for n in measures]


def moving_totals_by_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: dict[str, Column],
    rows: int,
) -> DataFrame:
    """Add each measure's total over the row and the `rows - 1` rows before it.

    `order` must tell all rows of a group apart.
    """
    hot = hot_groups(df, keys)
    ordered = Window.partitionBy(*keys).orderBy(*order)
    through_row = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_frame = ordered.rowsBetween(Window.unboundedPreceding, -rows)
    ordinary = df if hot is None else rows_not_in(df, hot, keys)
    result = ordinary.select(
        "*",
        *[_difference(m, through_row, before_frame).alias(n) for n, m in measures.items()],
    )
    if hot is None:
        return result

    # In a hot group the two totals sit in different segments. Each row sends
    # its running total to its own place and to the place `rows` further on.
    segmented = in_segments(rows_in(df, hot, keys), keys, order, hot.rows)
    counted = _with_counts(measures)
    numbered = totals_over_segments(segmented, keys, order, {_PLACE: F.lit(1), **counted})
    here = F.struct(
        F.col(_PLACE).alias(_PLACE),
        F.struct(*df.columns).alias(_ROW),
        *[F.col(n).alias(n) for n in counted],
    )
    further = F.struct(
        (F.col(_PLACE) + rows).alias(_PLACE),
        F.lit(None).cast(df.schema).alias(_ROW),
        *[(-F.col(n)).alias(n) for n in counted],
    )
    key_columns = [F.col(k).alias(f"key_{k}") for k in keys]
    by_place = (
        numbered.select(*key_columns, F.explode(F.array(here, further)).alias("sent"))
        .groupBy(*[f"key_{k}" for k in keys], f"sent.{_PLACE}")
        .agg(
            F.first(f"sent.{_ROW}", ignorenulls=True).alias(_ROW),
            *[F.sum(f"sent.{n}").alias(n) for n in counted],
        )
        .where(F.col(_ROW).isNotNull())
    )
    return result.unionByName(by_place.select(f"{_ROW}.*", *_null_without_values(measures)))


def moving_totals_by_time(
    df: DataFrame,
    keys: list[str],
    time: str,
    row_id: str,
    measures: dict[str, Column],
    seconds: float,
) -> DataFrame:
    """Add each measure's total over the group's rows of the last `seconds`.

    Both ends are included, and so are later rows with the row's own time. Rows
    without a time are added up by themselves.
    """
    hot = hot_groups(df, keys)
    ordered = Window.partitionBy(*keys).orderBy(F.unix_micros(time))
    through_row = ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before_frame = ordered.rangeBetween(Window.unboundedPreceding, -micros(seconds) - 1)
    ordinary = df if hot is None else rows_not_in(df, hot, keys)
    result = ordinary.select(
        "*",
        *[
            F.when(F.col(time).isNull(), F.sum(m).over(through_row))
            .otherwise(_difference(m, through_row, before_frame))
            .alias(n)
            for n, m in measures.items()
        ],
    )
    if hot is None:
        return result
    large = rows_in(df, hot, keys)
    totals = totals_between_marks(
        large, large, keys, time, time, row_id, seconds, 0, _with_counts(measures), 3 * hot.rows
    )
    return result.unionByName(totals.select(*df.columns, *_null_without_values(measures)))
