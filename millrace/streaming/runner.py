"""Running a stream over what its sources hold now."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..session import using_settings
from ..sources.scratch import new_path

# State is kept on local disk by RocksDB and its changes in the checkpoint
# folder, so state larger than memory works and a lost executor loses nothing.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


class Closing(NamedTuple):
    """A folder that a stream reads besides its source, empty until the source has ended."""

    folder: str
    row: DataFrame


# Later than any row, and far enough from the last instant that windows can be added.
LAST_INSTANT = "9000-01-01 00:00:00Z"
# The same for streams whose rows reach pandas, whose times end in 2262.
LAST_PANDAS_INSTANT = "2261-01-01 00:00:00Z"


def closable(stream: DataFrame, time: str, last: str = LAST_INSTANT) -> tuple[DataFrame, Closing]:
    """The stream, and what `drained` needs to close it.

    Closing sends one more row, which is null but for a time later than all
    others: the watermark passes everything that is open, and the row's own window
    is never given out.
    """
    spark = stream.sparkSession
    folder = new_path(spark, "closing")
    first = spark.range(1).select(
        *[
            (F.lit(last) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in stream.schema.fields
        ]
    )
    first.limit(0).write.parquet(folder)
    closing = spark.readStream.schema(stream.schema).parquet(folder)
    return stream.unionByName(closing), Closing(folder, first)


def drained(
    stream: DataFrame, label: str, path: str | None = None, closing: Closing | None = None
) -> DataFrame:
    """Process everything the sources hold, in append mode, and return the output.

    The file sink commits each batch once, and its files are the result; nothing
    passes through the driver. A run given the `path` of an earlier one goes on
    from where that one stopped. With `closing` the source is taken to have
    ended, and what is still open is given out as well.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, label)
    _run(stream, path)
    if closing is not None:
        closing.row.write.mode("append").parquet(closing.folder)
        _run(stream, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def _run(stream: DataFrame, path: str) -> None:
    with using_settings(stream.sparkSession, STATE_SETTINGS):
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("path", f"{path}/rows")
            .option("checkpointLocation", f"{path}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
