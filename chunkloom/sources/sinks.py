"""Sinks: Parquet by method, long metrics that grow, JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import exists


def _resumable(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if exists(spark, path) else None


def write_methods(df: DataFrame, path: str, methods: list[str] | None = None) -> None:
    """Chunks or timings, a folder a method. Methods in ``df`` replace theirs; others stay; methods listed without rows go."""
    spark = df.sparkSession
    rows = df if methods is None else df.filter(F.col("method").isin(*methods))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method").parquet(path)
    if methods:
        there = {r[0] for r in rows.select("method").distinct().collect()}
        jvm = spark.sparkContext._jvm
        for method in set(methods) - there:
            place = jvm.org.apache.hadoop.fs.Path(f"{path}/method={method}")
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def append_metrics(df: DataFrame, path: str) -> DataFrame:
    """Appends the (document, method, metric) rows that aren't stored yet; returns all."""
    spark = df.sparkSession
    before = _resumable(spark, path)
    keys = ["doc_name", "chunking_method", "metric_name"]
    new = df if before is None else df.join(before.select(*keys), keys, "left_anti")
    new.write.mode("append").partitionBy("metric_name").parquet(path)
    return spark.read.parquet(path)


def append_documents(df: DataFrame, path: str) -> DataFrame:
    """Appends the documents (by doc_name) that aren't stored yet, such as mentions; returns all."""
    before = _resumable(df.sparkSession, path)
    new = df if before is None else df.join(before.select("doc_name"), "doc_name", "left_anti")
    new.write.mode("append").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_json(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """JSON lines, a folder for each value of ``by``, which also stays a field."""
    if by:
        df.withColumn(f"{by}_folder", F.col(by)).write.mode(mode).partitionBy(f"{by}_folder").json(path)
    else:
        df.write.mode(mode).json(path)
