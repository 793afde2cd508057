"""Comparison reports over chunks, metrics and timings; each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import domain_of
from ..session import stored
from .select import TIE, best_methods, weight_of, weighted


def metametrics(chunks: DataFrame, metrics: DataFrame | None = None, weights: dict[str, float] | None = None, methods: list[str] | None = None) -> DataFrame:
    """Mean, largest, smallest, population deviation and number of chunk lengths of each method, and of the best method of each document."""
    rows = chunks.select("doc_name", "method", "chunk_len")
    own = F.array(F.when(F.lit(methods is None) | F.col("method").isin(*(methods or [])), F.col("method")))
    if metrics is not None and weights:
        # a chunk counts for its method and, if that is its document's best, once more: chunks are read once
        best = best_methods(metrics, weights).select("doc_name", F.col("method").alias("best"))
        rows = rows.join(best, "doc_name", "left")
        own = F.concat(own, F.array(F.when(F.col("method") == F.col("best"), "best")))
    rows = rows.select(F.explode(F.array_compact(own)).alias("method"), "chunk_len")
    n = F.col("chunk_len")
    return rows.groupBy("method").agg(F.avg(n).alias("mean"), F.max(n).alias("max"), F.min(n).alias("min"), F.stddev_pop(n).alias("std"), F.count("*").alias("count"))


def pivoted(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(doc_name, method) rows with a column a metric, their mean where one stands twice."""
    return metrics.groupBy("doc_name", F.col("chunking_method").alias("method")).pivot("metric_name", names).agg(F.avg("score"))


def overall_report(metrics: DataFrame, weights: dict[str, float], methods: list[str] | None = None, missing_as_zero: bool = False) -> DataFrame:
    """(metric_name, method, mean, std): with sample deviations, "best" for the best method of each document, and the weighted score.

    A best document without some metric is scored over the others, or with ``missing_as_zero`` as if it had zero.
    """
    rows = metrics.filter(F.col("metric_name").isin(*weights))
    if methods is not None:
        rows = rows.filter(F.col("chunking_method").isin(*methods))
    # the metrics of a document and method meet once; those of its best method count once more
    own = rows.groupBy("doc_name", F.col("chunking_method").alias("method")).agg(weighted(weights).alias("all"), F.collect_list(F.struct("metric_name", "score")).alias("found"))
    rank = F.row_number().over(Window.partitionBy("doc_name").orderBy(F.round("all", TIE).desc_nulls_last(), "method"))
    names = F.array_compact(F.array("method", F.when((F.col("rank") == 1) & F.col("all").isNotNull(), "best")))
    rows = own.withColumn("rank", rank).select(F.explode(names).alias("method"), "found").select("method", F.inline("found"))
    each = rows.groupBy("metric_name", "method").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"))
    w = weight_of(weights, F.col("metric_name"))
    score = F.coalesce("mean", F.lit(0.0)) if missing_as_zero else F.col("mean")
    total = F.sum(F.when(score.isNotNull(), w))
    final = each.groupBy("method").agg((F.sum(w * score) / total).alias("mean")).select(F.lit("weighted_score").alias("metric_name"), "method", "mean", F.lit(None).cast("double").alias("std"))
    return each.unionByName(final)


def per_document(metrics: DataFrame, weights: dict[str, float], methods: list[str] | None = None) -> DataFrame:
    """(doc_name, method, a column a metric, weighted_score, is_best)."""
    rows = metrics if methods is None else metrics.filter(F.col("chunking_method").isin(*methods))
    means = [F.avg(F.when(F.col("metric_name") == n, F.col("score"))).alias(n) for n in weights]
    rank = F.row_number().over(Window.partitionBy("doc_name").orderBy(F.round("weighted_score", TIE).desc_nulls_last(), "method"))
    out = rows.groupBy("doc_name", F.col("chunking_method").alias("method")).agg(*means, weighted(weights).alias("weighted_score"))
    return out.withColumn("is_best", (rank == 1) & F.col("weighted_score").isNotNull())


#: Decimal places up to which values are told apart.
PLACES = 9


def correlations(metrics: DataFrame, names: list[str], kendall: bool = True) -> DataFrame:
    """(metric_a, metric_b, pearson, spearman, kendall) over (document, method) rows that have all metrics.

    Spearman is Pearson's of mean ranks. Kendall's tau-b (values that agree in PLACES places tie) is counted bit by bit of one metric's values,
    by running sums over the other's: n log n rows, so no rows are paired.
    """
    wide = stored(pivoted(metrics, names).na.drop(subset=names).select("doc_name", "method", *names))  # read several times
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("v")) for n in names]))
    long = wide.select("doc_name", "method", values.alias("x")).select("doc_name", "method", "x.metric", "x.v")
    # mean ranks from the counts of distinct values: the window runs over values of a metric, not over rows
    counts = long.groupBy("metric", "v").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("metric").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = counts.select("metric", "v", (upto - F.col("n") / 2 + 0.5).alias("rank"))
    ranked = long.join(ranks, ["metric", "v"]).groupBy("doc_name", "method").pivot("metric", names).agg(F.first("rank"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    p = wide.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    s = ranked.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    stacked = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.col(f"c{i}").alias(name)) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
    out = stacked(p, "pearson").join(stacked(s, "spearman"), ["metric_a", "metric_b"])
    if not kendall:
        return out
    both = F.explode(F.array(*[F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"), F.round(F.col(a), PLACES).alias("va"), F.round(F.col(b), PLACES).alias("vb")) for a, b in pairs]))
    grid = wide.select(both.alias("x")).select("x.*").groupBy("metric_a", "metric_b", "va", "vb").agg(F.count("*").cast("double").alias("n"))
    whole = F.round(F.col("va") * 10**PLACES).cast("long")
    low, high = grid.agg(F.min(whole), F.max(whole)).first()
    # two rows of different va part at one bit, where the lesser has 0: at each bit, rows with 1 meet those with 0 below and above them in vb
    bits = F.sequence(F.lit(0), F.lit(max(0, ((high or 0) - (low or 0)).bit_length() - 1)))
    parted = grid.withColumn("at", whole - F.lit(low or 0)).withColumn("bit", F.explode(bits))
    block, one = F.expr("shiftright(at, bit + 1)"), F.expr("(shiftright(at, bit) & 1) = 1")
    counts = parted.groupBy("metric_a", "metric_b", "bit", block.alias("block"), "vb").agg(F.sum(F.when(one, 0.0).otherwise(F.col("n"))).alias("zeros"), F.sum(F.when(one, F.col("n")).otherwise(0.0)).alias("ones"))
    own = Window.partitionBy("metric_a", "metric_b", "bit", "block")
    below = F.coalesce(F.sum("zeros").over(own.orderBy("vb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    met = counts.select("metric_a", "metric_b", (F.col("ones") * (2 * below + F.col("zeros") - F.sum("zeros").over(own))).alias("s"))
    score = met.groupBy("metric_a", "metric_b").agg(F.sum("s").alias("s"))
    tied = lambda c: grid.groupBy("metric_a", "metric_b", c).agg(F.sum("n").alias("n")).groupBy("metric_a", "metric_b").agg((F.sum("n") * (F.sum("n") - 1) / 2 - F.sum(F.col("n") * (F.col("n") - 1) / 2)).alias(f"free_{c}"))
    tau = score.join(tied("va"), ["metric_a", "metric_b"]).join(tied("vb"), ["metric_a", "metric_b"])
    tau = tau.select("metric_a", "metric_b", F.when((F.col("free_va") > 0) & (F.col("free_vb") > 0), F.col("s") / F.sqrt(F.col("free_va") * F.col("free_vb"))).alias("kendall"))
    return out.join(tau, ["metric_a", "metric_b"], "left")


def metric_times(times: DataFrame) -> DataFrame:
    """(metric, time): sums, and a TOTAL row."""
    return times.rollup("metric").agg(F.sum("time").alias("time"), F.grouping("metric").alias("all")).select(F.when(F.col("all") == 1, "TOTAL").otherwise(F.col("metric")).alias("metric"), "time")


def chunking_times(times: DataFrame, concurrent: list[str] | None = None) -> DataFrame:
    """(method, time): sums; for methods whose documents run concurrently the longest."""
    slowest = F.col("method").isin(*(concurrent or [""]))
    return times.groupBy("method").agg(F.when(slowest, F.max("time")).otherwise(F.sum("time")).alias("time"))


def corpus_statistics(docs: DataFrame, tokens, page_tokens=None) -> DataFrame:
    """Per domain: documents, mean, deviation, largest and smallest of their tokens, pages a document, mean and deviation of page tokens.

    ``tokens`` maps a text column to its count. ``docs``: doc_name, full_text, pages; a document without pages is one page.
    """
    one = F.array(F.struct(F.lit(1).alias("page"), F.col("full_text").alias("text")))
    pages = F.when(F.size("pages") > 0, F.transform("pages", lambda p: F.struct(p["page"].alias("page"), p["text"].alias("text")))).otherwise(one)
    rows = docs.select(domain_of(F.col("doc_name")).alias("domain"), tokens(F.col("full_text")).alias("n"), pages.alias("pages"))
    own = rows.groupBy("domain").agg(
        F.count("*").alias("documents"), F.avg("n").alias("mean_tokens"), F.stddev_samp("n").alias("std_tokens"), F.max("n").alias("max_tokens"),
        F.min("n").alias("min_tokens"), F.avg(F.size("pages")).alias("pages_per_document"),
    )
    each = rows.select("domain", F.explode("pages").alias("p")).groupBy("domain").agg(F.avg(tokens(F.col("p.text"))).alias("mean_page_tokens"), F.stddev_samp(tokens(F.col("p.text"))).alias("std_page_tokens"))
    return own.join(each, "domain", "left")


def against_published(local: DataFrame, published: DataFrame) -> DataFrame:
    """(method, metric_name, mean, published, delta); methods without local results are pending (null)."""
    return published.join(local.select("method", "metric_name", "mean"), ["method", "metric_name"], "left").withColumn("delta", F.col("mean") - F.col("published"))


def length_histogram(chunks: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, low, high, count) of chunk lengths between the smallest and the largest; empty bins too."""
    ends = chunks.agg(F.min("chunk_len").cast("double").alias("low"), F.max("chunk_len").cast("double").alias("high"))
    wide = (F.col("high") - F.col("low")) / bins
    every = ends.filter("low is not null").select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "low", wide.alias("wide"))
    low, high = (ends.first() or (None, None)) if bins else (None, None)
    if low is None:
        return every.select("bin", "low", F.col("low").alias("high"), F.lit(0).cast("long").alias("count"))
    step = (high - low) / bins
    place = F.least(F.lit(bins - 1), F.floor((F.col("chunk_len") - low) / step)) if step else F.lit(0)
    n = chunks.filter("chunk_len is not null").groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    return every.join(n, "bin", "left").select("bin", (F.col("low") + F.col("bin") * F.col("wide")).alias("low"), (F.col("low") + (F.col("bin") + 1) * F.col("wide")).alias("high"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def answered_rate(generated: DataFrame, refusal: str) -> DataFrame:
    """(answered, total, percent): outputs without the refusal; whole percents, null if there are no outputs."""
    yes = F.count_if(~F.contains(F.coalesce("generated_output", F.lit("")), F.lit(refusal)))
    return generated.agg(yes.alias("answered"), F.count("*").alias("total")).withColumn("percent", F.when(F.col("total") > 0, F.floor(F.col("answered") * 100 / F.col("total")).cast("long")))
