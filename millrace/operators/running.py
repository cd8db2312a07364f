"""Running totals and carried values within ordered groups.

Measures are whole-number columns (see `functions.exact`), so that totals put
together from parts equal totals taken in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .segments import split_ordered, with_earlier_segments, within_segment


def _to_here(keys: list[str], order: list[str]):
    return (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def running_totals(
    df: DataFrame, keys: list[str], order: list[str], measures: dict[str, Column]
) -> DataFrame:
    """Add the total of each measure from the start of the group to the row.

    `order` must tell all rows of a group apart.
    """
    ordinary, segmented = split_ordered(df, keys, order)
    to_here = _to_here(keys, order)
    result = ordinary.select("*", *[F.sum(m).over(to_here).alias(n) for n, m in measures.items()])
    if segmented is None:
        return result
    return result.unionByName(
        totals_over_segments(segmented, keys, order, measures).select(*df.columns, *measures)
    )


def totals_over_segments(
    segmented: DataFrame, keys: list[str], order: list[str], measures: dict[str, Column]
) -> DataFrame:
    """`running_totals` over rows already in segments."""
    earlier = {f"{name}_earlier": (F.sum(m), F.sum) for name, m in measures.items()}
    here = within_segment(keys, order)
    return with_earlier_segments(segmented, keys, earlier).select(
        *segmented.columns,
        *[
            F.when(F.col(f"{name}_earlier").isNull(), F.sum(m).over(here))
            .otherwise(F.col(f"{name}_earlier") + F.coalesce(F.sum(m).over(here), F.lit(0)))
            .alias(name)
            for name, m in measures.items()
        ],
    )


def carry_forward(
    df: DataFrame, keys: list[str], order: list[str], column: str
) -> DataFrame:
    """Fill nulls of `column` with its last value earlier in the group.

    `order` must tell all rows of a group apart.
    """
    ordinary, segmented = split_ordered(df, keys, order)
    last = F.last(column, ignorenulls=True)
    result = ordinary.withColumn(column, last.over(_to_here(keys, order)))
    if segmented is None:
        return result
    last_in_segment = F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order)))
    earlier = {
        f"{column}_earlier": (last_in_segment, lambda c: F.last(c, ignorenulls=True)),
    }
    hot = with_earlier_segments(segmented, keys, earlier).withColumn(
        column, F.coalesce(last.over(within_segment(keys, order)), F.col(f"{column}_earlier"))
    )
    return result.unionByName(hot.select(*df.columns))
