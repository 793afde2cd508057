"""Chunking as a stream: per-document operators are narrow and stateless, so the same plans run on files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Counter, count_words
from ..operators.splitters import Splitter
from ..plans.pipeline import chunk_rows, with_spans
from ..sources.readers import from_table


def document_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Documents (doc_id, text) of Parquet files as they come."""
    reader = spark.readStream.schema("doc_id long, text string, lang string, source string, n_chars long")
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def chunk_stream(documents: DataFrame, splitter: Splitter, method: str, count: Counter = count_words) -> DataFrame:
    return chunk_rows(with_spans(from_table(documents), {method: splitter}, count))


def write_chunks(chunks: DataFrame, path: str, checkpoint: str):
    """Appends chunks by method; what the checkpoint has seen isn't computed again. Runs what is there, then stops."""
    return chunks.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("method").outputMode("append").trigger(availableNow=True).start()


def event_counts(events: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Tumbling counts and sums of events by type, with a watermark: (window_start, event_type, n, value)."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return found.select(F.col("window.start").alias("window_start"), "event_type", "n", "value")
