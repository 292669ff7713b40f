"""The column functions over streams of lines: validation, deduplication within a watermark, counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bohagi.functions.text import label_reason, normalize_label, split_name

SCHEMA = "id string, text string, split string, ingested_at timestamp"


def read_lines(spark: SparkSession, path: str, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(SCHEMA).format(fmt).option("maxFilesPerTrigger", files).load(path)


def validated(lines: DataFrame) -> DataFrame:
    """Lines in normal form with their reason; stateless, so the same over tables."""
    d = lines.withColumn("text", F.coalesce(normalize_label(F.col("text")), F.lit("")))
    return d.withColumn("reason", label_reason(F.col("text"))).withColumn("split", split_name(F.col("split")))


def first_seen(lines: DataFrame, late: str = "2 days") -> DataFrame:
    """Each text's first line; what a watermark has passed is forgotten, so state is bounded."""
    return lines.withColumn("digest", F.sha2("text", 256)).withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["digest"])


def reason_counts(lines: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(from_time, split, reason, n) by tumbling windows of arrival."""
    w = lines.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", window).alias("w"), "split", "reason").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("from_time"), "split", "reason", "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there, then an end; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
