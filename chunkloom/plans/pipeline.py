"""Documents to chunks to scores to the best chunks: lazy plans over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.batches import add_columns
from ..functions.text import Counter, count_words, page_starts
from ..functions.vectors import Embedder, HashingEmbedder
from ..operators import coref, metrics, postprocess, select
from ..operators.splitters import METHODS, PAPER_SEPARATORS, PerPage, RecursiveSplitter, Span, Splitter
from ..session import stored
from ..sources import parsers, readers

#: The five metrics that choose a method weigh the same.
WEIGHTS = {"size_compliance": 0.2, "block_integrity": 0.2, "intrachunk_cohesion": 0.2, "document_contextual_coherence": 0.2, "references_completeness": 0.2}
Post = Callable[[str, list[Span]], list[Span]]


FOUND = "found array<struct<method:string,chunk_index:bigint,start:int,end:int,chunk_len:bigint>>"


def _pages(pages: list[int] | None, text: str) -> list[Span]:
    out, at = [], 0
    for n in pages or ():
        out.append((at, at := at + n))
    return out or ([(0, len(text))] if text else [])


def with_spans(docs: DataFrame, methods: dict[str, Splitter | None], count: Counter = count_words, post: Post | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``found``, the spans of every method: one narrow pass over the texts. Without a splitter the pages are the chunks; a null text has no others.

    Of pages only the sizes are sent. With ``keep`` only these columns of the documents pass through.
    """

    def make():
        def work(text: str | None, pages: list[int] | None):
            null, text = text is None, text or ""
            found = []
            for name, splitter in methods.items():
                if splitter is None:
                    spans = _pages(pages, text)
                elif null:
                    spans = []
                else:
                    spans = splitter.paged(text, _pages(pages, text)) if isinstance(splitter, PerPage) else splitter.spans(text)
                for i, (a, b) in enumerate(post(text, spans) if post else spans):
                    found.append({"method": name, "chunk_index": i, "start": a, "end": b, "chunk_len": count(text[a:b])})
            return (found,)

        return work

    sizes = F.transform("pages", lambda p: F.length(F.coalesce(p["text"], F.lit(""))))
    return add_columns(docs, [F.col("full_text"), sizes], FOUND, make, keep)


def span_rows(docs: DataFrame, methods: dict[str, Splitter | None] | None = None, count: Counter = count_words, post: Post | None = None) -> DataFrame:
    """(doc_name, method, chunk_index, start, end, chunk_len): chunks without their texts, for metrics. No text leaves the worker."""
    return with_spans(docs, METHODS if methods is None else methods, count, post, ["doc_name"]).select("doc_name", F.explode("found").alias("s")).select("doc_name", "s.*")


def chunk_rows(spanned: DataFrame, kind: str = schemas.RAW) -> DataFrame:
    """Chunks, one a row, with pages and titles from their own document's row: no join, no shuffle."""
    starts = F.col("page_starts") if "page_starts" in spanned.columns else page_starts(F.col("pages"))
    rows = spanned.withColumn("page_starts", starts).select("doc_name", "full_text", "titles", "page_starts", F.explode("found").alias("s"))
    rows = rows.select("doc_name", "titles", "page_starts", "s.*", F.substring("full_text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("chunk_text"))
    return rows.select(
        "doc_name", "method", F.lit(kind).alias("type"), "chunk_index", "chunk_text", postprocess.pages_of(F.col("page_starts"), F.col("start"), F.col("end")).alias("chunk_pages"),
        postprocess.title_context(F.col("titles"), F.col("start"), F.col("chunk_text")).alias("titles_context"), "chunk_len", "start", "end",
    )


def split_documents(docs: DataFrame, methods: dict[str, Splitter | None] | None = None, count: Counter = count_words, post: Post | None = None, foreign: Callable[[str], bool] | None = None) -> DataFrame:
    """Chunks of every method, from one reading. With ``foreign`` documents in another language are left out; with ``post`` spans are regularised first."""
    if foreign is not None:
        docs = add_columns(docs, [F.col("full_text")], "is_foreign boolean", lambda: lambda text: (bool(text) and foreign(text),)).filter("not is_foreign").drop("is_foreign")
    docs = docs.withColumn("page_starts", page_starts(F.col("pages")))
    return chunk_rows(with_spans(docs, METHODS if methods is None else methods, count, post, ["doc_name", "full_text", "titles", "page_starts"]), schemas.NO_SMALL if post else schemas.RAW)


def postprocess_chunks(chunks: DataFrame, docs: DataFrame, post: Post, methods: list[str] | None = None, count: Counter = count_words, kind: str = schemas.NO_SMALL) -> DataFrame:
    """Stored chunks (with start, end) of some methods regularised, those of the others as they are."""
    listed = chunks if methods is None else chunks.filter(F.col("method").isin(*methods))
    spans = listed.groupBy("doc_name", "method").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "start", "end"))).alias("spans"))
    rows = spans.join(docs.select("doc_name", "full_text", "pages", "titles"), "doc_name")

    def make():
        def work(text: str, method: str, found: list[dict]):
            new = post(text, [(s["start"], s["end"]) for s in found])
            return ([{"method": method, "chunk_index": i, "start": a, "end": b, "chunk_len": count(text[a:b])} for i, (a, b) in enumerate(new)],)

        return work

    new = chunk_rows(add_columns(rows, [F.col("full_text"), F.col("method"), F.col("spans")], FOUND, make).drop("method", "spans"), kind)
    return new if methods is None else new.unionByName(chunks.filter(~F.col("method").isin(*methods)).select(*new.columns))


def chunk_files(spark: SparkSession, path: str, make_parser: Callable[[], parsers.Parser] | None = None, chunk_size: int = 600, chunk_overlap: int = 50, separators: tuple[str, ...] = PAPER_SEPARATORS, merging: str = "small_only", min_chunk_tokens: int = 100, count: Counter = count_words, output: str | None = None) -> DataFrame:
    """The library's front door: a file or a directory to chunks (doc_name, chunk_index, chunk_text, chunk_pages, titles_context, chunk_len).

    Without a parser the files are parsed documents in JSON. A document that can't be parsed is left out; with ``output`` chunks are stored there.
    """
    if not readers.exists(spark, path):
        raise FileNotFoundError(path)
    docs = readers.parsed_documents(spark, path) if make_parser is None else parsers.parse_directory(spark, path, make_parser).filter("error is null")
    splitter = RecursiveSplitter(chunk_size, chunk_overlap, count, regex=True, separators=separators, merging=merging, min_chunk_tokens=min_chunk_tokens)
    found = chunk_rows(with_spans(docs, {"recursive": splitter}, count)).drop("method", "type", "start", "end")
    if output:
        found.write.mode("overwrite").parquet(output)
        return spark.read.parquet(output)
    return found


def score(docs: DataFrame, chunks: DataFrame, make_embedder: Callable[[], Embedder] = HashingEmbedder, pairs: DataFrame | None = None, count: Counter = count_words, done: DataFrame | None = None) -> DataFrame:
    """All metrics in long form; without pairs those of the offline solver are used."""
    pairs = coref.pair_rows(coref.find_mentions(docs, count=count)) if pairs is None else pairs
    return metrics.all_metrics(chunks, docs, make_embedder, pairs, count, done)


def adaptive(docs: DataFrame, methods: dict[str, Splitter | None] | None = None, weights: dict[str, float] | None = None, count: Counter = count_words, folder: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, metrics, best): every method, scored, and each document's best one. With ``folder`` chunks and metrics are stored between.

    Without one the spans alone are stored, as several metrics read them.
    """
    spark, post = docs.sparkSession, postprocess.Postprocessor(count=count)
    chunks = split_documents(docs, methods, count, post)
    if folder:
        chunks.write.mode("overwrite").partitionBy("method").parquet(f"{folder}/chunks")
        spans = chunks = spark.read.parquet(f"{folder}/chunks")
    else:
        spans = stored(span_rows(docs, methods, count, post))
    scores = score(docs, spans, count=count)
    if folder:
        scores.write.mode("overwrite").parquet(f"{folder}/metrics")
        scores = spark.read.parquet(f"{folder}/metrics")
    return chunks, scores, select.best_methods(scores, weights or WEIGHTS)
