"""Parquet tables with declared schemas, as batches or as streams.

A declared schema spares the footer-reading job that inference needs, which on
a table of a million files is a long wait before the first task starts. Parquet
still prunes columns and takes pushed filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# The event time is stored without a zone and read as a UTC instant: Parquet
# holds it as microseconds, which are taken as they are.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
        " o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp, user_id bigint, event_type string, value double,"
        " props string"
    ),
    "pages": "page_id bigint, url string, html string",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The named table as a batch DataFrame."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def in_years(df: DataFrame, time: str, first: int, end: int) -> DataFrame:
    """Rows whose zone-free `time` is in the years from `first` to before `end`.

    Parquet skips nothing by such times. A table laid out in folders named
    `<time>_year=<year>`, as `write_by_year` lays it out, is pruned to the years asked
    for; any other is read and filtered.
    """
    start, stop = (F.lit(f"{year}-01-01").cast("timestamp_ntz") for year in (first, end))
    rows = df.where((F.col(time) >= start) & (F.col(time) < stop))
    folder = f"{time}_year"
    if folder not in df.columns:
        return rows
    return rows.where((F.col(folder) >= first) & (F.col(folder) < end))


def write_by_year(df: DataFrame, time: str, path: str) -> None:
    """Write a table in one folder for each year of `time`; rows without a time get their own."""
    df.withColumn(f"{time}_year", F.year(time)).write.partitionBy(f"{time}_year").parquet(path)


def stream_table(
    spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None
) -> DataFrame:
    """The named table, a file or a folder of files, as a stream, oldest file first.

    `files_per_batch` bounds what one micro-batch reads. With it, files must
    arrive in event-time order to within the watermark delay of the query.
    """
    reader = spark.readStream.schema(SCHEMAS[name])
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # A pattern, because as a plain path a stream takes only a folder.
    return reader.parquet(f"{folder}/{{{name}.parquet}}")
