"""Keys that make up a given share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.scratch import write_once
from .hot_groups import same_keys

# Spark's own bound for the list of candidates.
LEAST_SHARE = 0.0002


def frequent_keys(df: DataFrame, keys: list[str], share: float, count: str = "n_rows") -> DataFrame:
    """The keys that at least `share` of all rows have, with their exact number of rows.

    The first scan keeps a short list of candidates in each task (Misra and Gries),
    which holds every key above the share whatever the order of rows; the lists are
    merged, and hold two over `share` keys at most. The second scan counts the
    candidates only, and nothing else is shuffled. Null is a key like any other. An
    empty table has no keys.
    """
    if not LEAST_SHARE <= share <= 1:
        raise ValueError(f"the share must be from {LEAST_SHARE} to 1")
    millionths = round(share * 1_000_000)
    one = df.select(F.struct(*keys).alias("key"))
    # Half the share, so that a key of exactly the share is on the list.
    found = one.freqItems(["key"], share / 2).select(F.explode("key_freqItems").alias("key"))
    candidates = write_once(found.select("key.*"), "candidates")
    # At most two over the share rows.
    listed = df.select(*keys).join(F.broadcast(candidates), same_keys(df, candidates, keys), "left_semi")
    total = df.count()  # one number, for files of columns from their footers
    counted = listed.groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    return counted.where(F.col(count) * 1_000_000 >= F.lit(total * millionths))
