"""Queries over web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.hyperlinks import exploded, host_pairs, with_links
from ..sources.tables import read_table


def links_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link of every page, with its place among the page's links."""
    links = exploded(with_links(read_table(spark, sf_dir, "pages")))
    return links.select(
        "page_id", (F.col("at") + 1).alias("place"), "link.target", F.col("link.host").alias("to_host")
    )


def links_between_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, and pages that have them, by the hosts they lead from and to."""
    return host_pairs(with_links(read_table(spark, sf_dir, "pages")))
