"""Dropping repeated deliveries from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame


def without_repeats(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first delivery of each key that is in time; repeats within `delay` of it are dropped.

    `time` is an instant. The rows of one key meet in the task that holds its state.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
