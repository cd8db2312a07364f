"""Connected components of a table of links, by alternating stars.

Large star: every node sends its larger neighbours to the least node it knows.
Small star: every node sends its smaller ones there. Both keep components and
end in one star per component, after rounds that grow with the logarithm of its
size. Each round is one aggregation and one join, and is written before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import write_once


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    sent = both.filter("b > a").join(least, "a")
    return sent.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    sent = links.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return sent.union(least.select("a", F.col("m").alias("b")))


def _mark(links: DataFrame) -> tuple:
    """Count and checksum of a set of links: two numbers, whatever its size."""
    sums = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
    )
    row = sums.first()
    return row["n"], row["h"]


def components(links: DataFrame) -> DataFrame:
    """a and the least node b of its component, for every node that is not the least.

    `links` has two bigint columns a and b without nulls; loops and repeats do
    no harm. No links give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    ordered = links.filter("a != b").select(high.alias("a"), low.alias("b")).distinct()
    now = write_once(ordered, "links")
    mark = _mark(now)
    while mark[0]:
        starred = write_once(_large(now).distinct(), "links")
        now = write_once(_small(starred).distinct(), "links")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now
