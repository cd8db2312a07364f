"""Per-key progress that is reset when the key falls silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def session_totals(
    stream: DataFrame,
    time: str,
    delay: str,
    gap: str,
    keys: list[str],
    aggregates: dict[str, Column],
) -> DataFrame:
    """Aggregates per key and session, given out once the watermark closes the
    session. A session's end is its last row's time plus the gap.

    `time` is an instant. The runner has Spark merge the sessions within each
    task before the shuffle, so a key that makes up a third of the stream sends
    a few partial sessions and not its rows.
    """
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap).alias("session"), *keys)
        .agg(*[a.alias(name) for name, a in aggregates.items()])
        .select(
            *keys,
            F.col("session.start").alias("session_start"),
            F.col("session.end").alias("session_end"),
            *aggregates,
        )
    )
