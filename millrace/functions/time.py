"""Instants and zone-free timestamps.

Operators take event times as instants (Spark's `timestamp`): Spark computes
with their microseconds directly, and streams need them for watermarks. Casting
between the two types goes through the session's time zone; these helpers do
not, so results are the same whatever zone a session is set to.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_DAY = 24 * 60 * 60 * 1_000_000
_UNITS = {
    "microsecond": 1,
    "millisecond": 1000,
    "second": 1_000_000,
    "minute": 60 * 1_000_000,
    "hour": 3600 * 1_000_000,
    "day": _DAY,
    "week": 7 * _DAY,
}


def zone_free(instant: Column | str) -> Column:
    """The UTC clock time of an instant, as a timestamp without a zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), start)


def micros(seconds: float) -> int:
    return round(seconds * 1_000_000)


def duration(text: str) -> int:
    """Microseconds of a length of time such as `1 hour 30 minutes`."""
    parts = text.lower().removeprefix("interval").split()
    if not parts or len(parts) % 2:
        raise ValueError(f"not a length of time: {text}")
    return sum(
        round(float(n) * _UNITS[unit.removesuffix("s")]) for n, unit in zip(parts[::2], parts[1::2])
    )


def bucket_start(at: Column, width: int) -> Column:
    """The largest multiple of `width` that is not above `at`."""
    return at - F.pmod(at, F.lit(width).cast("bigint"))


def utc_day(instant: Column | str) -> Column:
    """The instant at which the UTC day of an instant began."""
    return F.timestamp_micros(bucket_start(F.unix_micros(instant), _DAY))
