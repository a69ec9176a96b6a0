"""Streams: profiles of arriving objects, beyond what batch runs offer.  Percentiles of a stream are approximate; exact ones need the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving_objects(spark: SparkSession, root: str) -> DataFrame:
    """(uri, size, at) of files that appear in a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(root)
    return files.select(F.col("path").alias("uri"), F.col("length").alias("size"), F.col("modificationTime").alias("at"))


def windowed_profile(objects: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count, bytes, mean and approximate median by window of time; what comes later than ``late`` is left out."""
    return objects.withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count("*").alias("object_count"), F.sum("size").alias("total_bytes"), F.avg("size").alias("mean_bytes"), F.percentile_approx("size", 0.5).alias("median_bytes"))


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """All that has arrived, in batches handed to ``sink``; goes on from the checkpoint when it is started again."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
