"""The best method of each document, and its chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores that agree to so many places tie, whatever the order of their sums.
TIE = 9


def weight_of(weights: dict[str, float], metric: Column) -> Column:
    """Null for a metric without a weight."""
    return F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])[metric]


def weighted(weights: dict[str, float]) -> Column:
    """Aggregate: mean of the metrics with a weight, over those that aren't null; null if none is."""
    w = F.when(F.col("score").isNotNull() & ~F.isnan("score"), weight_of(weights, F.col("metric_name")))
    return F.sum(w * F.col("score")) / F.sum(w)


def weighted_scores(metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(doc_name, method, score): ``weighted`` of each document and method."""
    known = metrics.filter(F.col("metric_name").isin(*weights))
    return known.groupBy("doc_name", F.col("chunking_method").alias("method")).agg(weighted(weights).alias("score"))


def best_methods(metrics: DataFrame, weights: dict[str, float], candidates: list[str] | None = None) -> DataFrame:
    """(doc_name, method, score) of the best method of each document; ties go to the first by name. A document without any score has none."""
    if not weights:
        raise ValueError("weights are needed")
    scores = weighted_scores(metrics, weights).filter("score is not null")
    if candidates is not None:
        scores = scores.filter(F.col("method").isin(*candidates))
    rank = F.row_number().over(Window.partitionBy("doc_name").orderBy(F.round("score", TIE).desc(), "method"))
    return scores.withColumn("rank", rank).filter("rank = 1").drop("rank")


def chosen_methods(metrics: DataFrame, weights: dict[str, float], default: str = "page") -> DataFrame:
    """As ``best_methods``, and for documents without a score the default method if they have it, else their first. The metrics are read once."""
    if not weights:
        raise ValueError("weights are needed")
    names = F.collect_list(F.struct("metric_name"))
    each = metrics.groupBy("doc_name", "chunking_method").agg(weighted(weights).alias("score"), (F.size(names) > F.size(F.array_distinct(names))).alias("twice"))
    best = F.min(F.when(F.col("score").isNotNull(), F.struct((-F.round("score", TIE)).alias("rank"), "chunking_method")))["chunking_method"]
    spare = F.min(F.struct((F.col("chunking_method") != default).alias("other"), "chunking_method"))["chunking_method"]
    own = each.groupBy("doc_name").agg(F.max("twice").alias("twice"), F.coalesce(best, spare).alias("method"))
    checked = own.filter(F.when(F.col("twice"), F.raise_error(F.concat(F.lit("a metric stands twice for "), F.col("doc_name")))).otherwise(F.lit(True)).cast("boolean"))
    return checked.select("doc_name", "method")


def packed_chunks(chunks: DataFrame) -> DataFrame:
    """(doc_name, method, chunks): a document's chunks in order as one row, with their texts trimmed."""
    one = F.struct("chunk_index", F.trim("chunk_text").alias("chunk_text"), F.coalesce("titles_context", F.lit("")).alias("titles_context"), F.col("chunk_pages").cast("array<int>").alias("chunk_pages"))
    rows = chunks.groupBy("doc_name", "method").agg(F.array_sort(F.collect_list(one)).alias("all"))
    return rows.select("doc_name", "method", F.transform("all", lambda c: F.struct(c["chunk_text"].alias("chunk_text"), c["titles_context"].alias("titles_context"), c["chunk_pages"].alias("chunk_pages"))).alias("chunks"))


def best_chunks(chunks: DataFrame, metrics: DataFrame, weights: dict[str, float], default: str = "page") -> DataFrame:
    """Chunks of each document's chosen method, one row a document; documents without metrics are left out."""
    return packed_chunks(chunks.join(chosen_methods(metrics, weights, default), ["doc_name", "method"]))


def selected_chunks(frames: dict[str, DataFrame], selection: list[tuple[str, str]]) -> dict[tuple[str, str], DataFrame]:
    """Packed chunks for each (frame, method) of the selection; entries without such a frame are left out."""
    return {(name, method): packed_chunks(frames[name].filter(F.col("method") == method)) for name, method in selection if name in frames}
