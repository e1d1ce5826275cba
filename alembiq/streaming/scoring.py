"""Streams: the row-wise operators over files that arrive, and windowed counts with late data.

Rules, units, labels and screens are projections and filters, so they run on streams as they are.
Duplicates across batches are dropped within a watermark; tumbling counts end at the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def distinct_within(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, end, the group and its number of rows and mean value, for each tumbling window."""
    out = stream.withWatermark(time, late).groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "mean")


def run(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply ``transform`` to all that has arrived, append it as Parquet, and stop; a later run goes on where this one ended."""
    return transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def latest(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> DataFrame:
    """What a stream of updated rows (a windowed count, say) holds once all that has arrived is in: the last update of each key.

    Each batch's updates are a folder of Parquet files, named by the batch, so one that is run again replaces its own.
    """
    names, kinds = stream.columns, stream.schema

    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={i}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.schema(kinds.add("batch", "long") if "batch" not in names else kinds).parquet(out)
    rest = [c for c in names if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest]).select(*names)
