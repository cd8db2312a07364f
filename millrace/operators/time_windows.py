"""Tumbling, sliding and session windows over stored rows.

All three add rows up per pane before anything else. The panes are combined on
the map side, so a key or an hour that holds a third of the rows reaches the
shuffle as one row per pane and task, and later steps work on panes, whose
number depends on the time covered and not on the number of rows.

Measures are whole-number expressions that add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.time import bucket_start, duration, micros

_PANE = "pane"


def _sums(measures: dict[str, Column]) -> list[Column]:
    return [F.sum(m).alias(name) for name, m in measures.items()]


def _resums(measures: dict[str, Column]) -> list[Column]:
    return [F.sum(name).alias(name) for name in measures]


def tumbling_totals(
    df: DataFrame, time: str, width: str, keys: list[str], measures: dict[str, Column]
) -> DataFrame:
    """Totals per key and window of fixed width."""
    return (
        df.groupBy(F.window(time, width).alias(_PANE), *keys)
        .agg(*_sums(measures))
        .select(
            F.col(f"{_PANE}.start").alias("window_start"),
            F.col(f"{_PANE}.end").alias("window_end"),
            *keys,
            *measures,
        )
    )


def sliding_totals(
    df: DataFrame, time: str, width: str, slide: str, keys: list[str], measures: dict[str, Column]
) -> DataFrame:
    """Totals per key and window of `width` that starts every `slide`.

    `slide` must divide `width`: then every window is made of whole panes, and
    it is panes rather than rows that are repeated for each window.
    """
    if duration(width) % duration(slide):
        raise ValueError(f"a slide of {slide} does not divide a width of {width}")
    panes = tumbling_totals(df, time, slide, keys, measures)
    return (
        panes.groupBy(F.window("window_start", width, slide).alias(_PANE), *keys)
        .agg(*_resums(measures))
        .select(
            F.col(f"{_PANE}.start").alias("window_start"),
            F.col(f"{_PANE}.end").alias("window_end"),
            *keys,
            *measures,
        )
    )


def session_totals(
    df: DataFrame, keys: list[str], time: str, gap_seconds: float, measures: dict[str, Column]
) -> DataFrame:
    """Totals per key and session; a session ends when no row follows within
    the gap. Its end is the last row's time plus the gap.

    Rows in one pane as long as the gap cannot be a gap apart, so a session is
    made of whole panes.
    """
    gap = micros(gap_seconds)
    at = F.unix_micros(time)
    panes = df.groupBy(*keys, bucket_start(at, gap).alias(_PANE)).agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), *_sums(measures)
    )
    in_order = Window.partitionBy(*keys).orderBy(_PANE)
    quiet = F.col("first_at") - F.lag("last_at").over(in_order)
    return (
        panes.withColumn("opens", F.when(quiet > gap, 1).otherwise(0))
        .withColumn("session_no", F.sum("opens").over(in_order))
        .groupBy(*keys, "session_no")
        .agg(
            F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), *_resums(measures)
        )
        .select(
            *keys,
            F.timestamp_micros("first_at").alias("session_start"),
            F.timestamp_micros(F.col("last_at") + gap).alias("session_end"),
            *measures,
        )
    )
