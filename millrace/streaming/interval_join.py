"""Joining two streams on equal keys and nearby times."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_SALT = "salt"


def interval_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    left_id: str,
    before: float,
    after: float,
    left_delay: str,
    right_delay: str,
    salts: int = 1,
) -> DataFrame:
    """Pairs whose right time is from `before` seconds before the left time to
    `after` seconds after it.

    Times are instants. With `salts` above 1, left rows of a key are dealt out over
    that many tasks and right rows are sent to all of them, so the busier stream
    belongs on the left; state then holds each right row `salts` times.
    A live stream's rows are all close in time, which is why the key is split by
    salt and not by time. The time bounds let Spark drop state that the
    watermarks have passed. Apart from the keys, column names must differ.
    """
    dealt = left.withWatermark(left_time, left_delay).withColumn(
        _SALT, F.pmod(F.xxhash64(left_id), F.lit(salts))
    )
    repeated = right.withWatermark(right_time, right_delay).withColumn(
        _SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    )
    lower = dealt[left_time] - F.expr(f"INTERVAL {before} SECONDS")
    upper = dealt[left_time] + F.expr(f"INTERVAL {after} SECONDS")
    same = [dealt[k] == repeated[k] for k in [*keys, _SALT]]
    near = [repeated[right_time] >= lower, repeated[right_time] <= upper]
    joined = dealt.join(repeated, [*same, *near])
    return joined.select(
        *[dealt[c] for c in left.columns],
        *[repeated[c] for c in right.columns if c not in keys],
    )
