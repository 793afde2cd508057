"""Scans of everything that is stored, by paths that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import stem

EMPTY_TITLES = "cast(array() as array<struct<title:string,start:int,end:int,level:int>>)"


def parsed_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed documents of JSON files (a directory, not its subfolders, or one file); ``doc_name`` is the file's stem.

    Pages may be stored as a list of {page, text} or as an object from numbers to texts, whose order is that of its numbers.
    """
    shape = "document_name string, pages string, full_text string, split_points array<int>, titles array<struct<title:string,start:int,end:int,level:int>>"
    rows = spark.read.schema(shape).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    listed = F.from_json("pages", "array<struct<page:int,text:string>>")
    keyed = F.array_sort(F.transform(F.map_entries(F.from_json("pages", "map<string,string>")), lambda e: F.struct(e["key"].cast("int").alias("page"), e["value"].alias("text"))))
    pages = F.when(F.startswith(F.ltrim("pages"), F.lit("[")), listed).otherwise(keyed)
    return rows.select(stem(F.input_file_name()).alias("doc_name"), "document_name", pages.alias("pages"), "full_text", "split_points", "titles")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """Stored chunks; their order is that of chunk_index, never that of files."""
    return schemas.conform(spark.read.parquet(path), schemas.CHUNK)


def mentions(spark: SparkSession, path: str) -> DataFrame:
    return schemas.conform(spark.read.parquet(path), schemas.MENTIONS)


def metrics(spark: SparkSession, path: str) -> DataFrame:
    return schemas.conform(spark.read.parquet(path), schemas.METRIC)


def best_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(doc_name, method, chunk_id, text, titles_context, chunk_pages): stored best chunks, one a row; ids are places in their document."""
    rows = spark.read.schema(schemas.BEST_CHUNKS).option("multiLine", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path)
    flat = rows.select("doc_name", "method", F.posexplode("chunks").alias("chunk_id", "c"))
    return flat.select("doc_name", "method", "chunk_id", F.col("c.chunk_text").alias("text"), "c.titles_context", "c.chunk_pages")


def queries_csv(spark: SparkSession, path: str, column: str = "English Question") -> DataFrame:
    """(query_text): a column of a semicolon-separated file with a header."""
    rows = spark.read.option("sep", ";").option("header", True).option("multiLine", True).csv(path)
    return rows.select(F.col(f"`{column}`").alias("query_text"))


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON records of a stated schema (QA, RETRIEVAL, GENERATION, EVALUATION, SUMMARY, FILTERED_QUERY)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def from_table(documents: DataFrame, name: str = "doc_id", text: str = "text", pages: bool = True, nulls: bool = False) -> DataFrame:
    """Documents of a plain table: one page, a block a line, no titles. Null texts count as empty, or with ``nulls`` stay null."""
    body = F.col(text) if nulls else F.coalesce(F.col(text), F.lit(""))
    # line starts are the running lengths of the lines before; the last one is a line break behind the text's end
    inside = lambda a: F.filter(a, lambda p: (p > 0) & (p < F.element_at(a, -1) - 1))
    inner = F.aggregate(F.split(body, "\n"), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1)), inside)
    page = F.array(F.struct(F.lit(1).alias("page"), body.alias("text")))
    return documents.select(F.col(name).cast("string").alias("doc_name"), F.col(name).cast("string").alias("document_name"), page.alias("pages"), body.alias("full_text"), inner.alias("split_points"), F.expr(EMPTY_TITLES).alias("titles"))


def binary_files(spark: SparkSession, path: str, pattern: str, done: DataFrame | None = None) -> DataFrame:
    """(doc_name, path, content) of matching files below a path; names in ``done`` are left out before any content is read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    rows = rows.select(stem(F.col("path")).alias("doc_name"), "path", "content")
    return rows if done is None else rows.join(done.select("doc_name").distinct(), "doc_name", "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def mentions_folder(spark: SparkSession, computed: str, shipped: str) -> str | None:
    """The computed mentions if they are there, else the shipped ones, else none: reference scores are then null."""
    return next((p for p in (computed, shipped) if exists(spark, p)), None)
