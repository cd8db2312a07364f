"""What the operators of this subpackage share."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.sources.scratch import write_once

__all__ = ["arrow_batches", "keyed", "table", "text_slices", "write_once"]

# Bytes of text handled at once in a Python task: bounds its arrays, whatever
# number of rows an Arrow batch has.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the given folder, read only through Spark."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def column(df: DataFrame, name: str):
    """The named column, whatever characters its name has."""
    return df[f"`{name}`"]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only key and text, as `id` and `text`, so that no other column can clash."""
    return df.select(
        column(df, id_col).alias("id"), column(df, text_col).cast("string").alias("text")
    )


def packed(df: DataFrame, text_col: str) -> DataFrame:
    """Whole rows as one column `row` beside `text`, so that no name can clash."""
    return df.select(
        F.struct(*[column(df, c).alias(c) for c in df.columns]).alias("row"),
        column(df, text_col).cast("string").alias("text"),
    )


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand tasks at most `rows` rows, and about 16 MB, at a time, as texts can be long.

    Only the size of what travels at once; results do not depend on it. Tasks
    look for this package where the driver has it; a cluster that keeps it
    elsewhere, or ships it, finds it there as well.
    """
    here = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    if here not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(x for x in (known.get("PYTHONPATH"), here) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_slices(texts: list[bytes], most: int = SLICE_BYTES):
    """Ranges (from, to) of rows with about `most` bytes; a longer text is one range."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def utf8(column) -> list[bytes]:
    """An Arrow text column as UTF-8 bytes; null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
