"""A training corpus from raw documents: quality, near copies, repeated passages, mix, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared folder and reads it
again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import bpe, mixing, quality, simhash, substrings
from chunkloom.llm.common import read, shared_folder, tuned
from chunkloom.llm.registry import MIX


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go.

    Null, empty and short texts get no votes and are judged by the scorer's bias alone; of any length, the whole text is read. Equal texts are
    judged alike, so repeated rows stay or go together and ids may be null or repeated; an empty table stays empty; further columns are kept.
    """
    return quality.accepted(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: five-word shingles, a likeness of 0.8 or more.

    Null and empty texts are copies of each other; texts under five words are copies if their words are equal; very long texts count
    whole. Null ids come last, ties go by a hash of the row; of rows that agree in all columns one stays. An empty table stays empty; further
    columns are kept.
    """
    return simhash.first_of_groups(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows of 35 words that start more than once in the corpus go; n_chars follows the text.

    Null texts stay null and empty ones empty; texts under 35 words stay as they are; very long ones are read whole. Repeated rows repeat each
    other, so both lose the words; ids play no part and may be null or repeated. An empty table stays empty; further columns are kept.
    """
    left = substrings.dedup(docs, replace=True)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages in the target shares of words, without repeating a document.

    Null and empty texts have no words and are taken at the rate of the prior; very long ones count with all their words. Equal rows get
    equal rates and the same draw; null ids are drawn by their text. An empty table stays empty; further columns are kept.
    """
    return mixing.mixed(docs, MIX, most=1.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to: doc_id, n_tokens, ids_sha256, decoded_sha256, ids.

    Null texts count as empty: no ids. Very long texts are encoded whole. Repeated rows and null or repeated ids give a row each; an empty table
    gives no rows; further columns are not read.
    """
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality", good_quality), ("near copies", without_near_copies), ("repeated passages", without_repeats), ("mix", mix), ("tokens", tokens)]

#: Expectation-maximisation, components and merges aren't expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's folder goes when the next one is written."""
    folder = f"{shared_folder(tuned(spark))}/corpus-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}")
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
