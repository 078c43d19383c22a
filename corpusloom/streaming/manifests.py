"""Manifests that arrive as files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import normalize_uroman, tokenize


def stream_jsonl(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the JSON lines files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def tokenized_stream(rows: DataFrame, text: str = "transcript") -> DataFrame:
    """The row-local text steps on a stream."""
    return rows.withColumn("tokenized", tokenize(F.col(text))).withColumn("uroman", F.transform("tokenized", normalize_uroman))


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(start, key, n) over tumbling windows; rows later than the watermark are left out."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), key, "n")


def write_parquet_stream(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to Parquet and ends when all files present are done."""
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def for_each_batch(rows: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to ``write``."""
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
