"""Joins against the distinct keys or per-key totals of a large table.

The many side is reduced to one row per key before it meets the other side. The
reduction is combined on the map side and shuffles on the join key, so the join
needs no further shuffle of that side and a key with a third of all rows arrives
as one row per task. Catalyst and adaptive execution choose the join strategy
from measured sizes; no side is broadcast by hint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def having_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows whose key occurs on the right."""
    seen = right.select(right_key).distinct()
    return left.join(seen, left[left_key] == seen[right_key], "left_semi")


def lacking_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows whose key does not occur on the right."""
    seen = right.select(right_key).distinct()
    return left.join(seen, left[left_key] == seen[right_key], "left_anti")


def with_match_totals(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, totals: list[Column],
    how: str = "left",
) -> DataFrame:
    """Left rows with aggregates over the right rows of the same key."""
    per_key = right.groupBy(right_key).agg(*totals)
    return left.join(per_key, left[left_key] == per_key[right_key], how).drop(right_key)
