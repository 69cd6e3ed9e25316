"""Streaming forms of the append-only result log (an extension: the batch operators need none of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_log(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def _timed(log: DataFrame, at: str) -> DataFrame:
    """Watermarks need instants: times without a zone are taken in the session's."""
    return log.withColumn(at, F.col(at).cast("timestamp"))


def once_each(log: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The first record of each key; keys are forgotten once the watermark has passed them."""
    return _timed(log, at).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_means(log: DataFrame, at: str, value: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count and mean by window and key; records later than the watermark are dropped."""
    w = F.window(at, width)
    return _timed(log, at).withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), by, "n", "mean")


def run_to_end(out: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; a later call goes on from the checkpoint."""
    q = out.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
