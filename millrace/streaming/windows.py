"""Windowed totals over event time with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tumbling_totals(
    stream: DataFrame,
    time: str,
    delay: str,
    width: str,
    keys: list[str],
    measures: dict[str, Column],
) -> DataFrame:
    """Totals per key and window, given out once the watermark closes the window.

    `time` is an instant. Each batch is added up on the map side before its
    shuffle, and state holds one row per key and open window.
    """
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, width).alias("pane"), *keys)
        .agg(*[F.sum(m).alias(name) for name, m in measures.items()])
        .select(
            F.col("pane.start").alias("window_start"),
            F.col("pane.end").alias("window_end"),
            *keys,
            *measures,
        )
    )
