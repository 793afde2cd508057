"""Schemas of everything that is stored: parsed documents, chunks, metrics, mentions, retrieval and evaluation records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import _parse_datatype_string

#: An ordered array of pages, not a map: the order of pages is part of a document.
DOCUMENT = "document_name string, pages array<struct<page:int,text:string>>, full_text string, split_points array<int>, titles array<struct<title:string,start:int,end:int,level:int>>"
CHUNK = "doc_name string, method string, type string, chunk_index long, chunk_text string, chunk_pages array<long>, titles_context string, chunk_len long"
SPANS = "array<struct<start:int,end:int>>"
METRIC = "doc_name string, chunking_method string, metric_name string, score double"
CHUNK_TIME = "doc_name string, method string, method_type string, time double"
METRIC_TIME = "doc_name string, metric string, time double"
MENTIONS = "doc_name string, mentions array<array<array<long>>>, entity_pron_mentions array<array<array<long>>>"
BEST_CHUNKS = "doc_name string, method string, chunks array<struct<chunk_text:string,titles_context:string,chunk_pages:array<int>>>"
QA = "id long, doc_name string, question string, answer string"
_META = "struct<chunk_id:int,doc_name:string,chunking_method:string,chunk_pages:array<int>>"
_HITS = f"array<struct<content:string,meta:{_META},score:double>>"
RETRIEVAL = f"query_id long, query_text string, reference_answer string, reference_answer_doc_name string, results {_HITS}"
GENERATION = f"query_id long, query_text string, reference_answer string, reference_answer_doc_name string, context_data {_HITS}, generated_output string"
EVALUATION = f"query_id long, query_text string, generated_output string, reference_answer string, reference_answer_doc_name string, context_data {_HITS}, metrics array<struct<name:string,score:double,threshold:double,success:boolean,reason:string,error:string>>, success boolean"
FILTERED_QUERY = "query_id long, relevant boolean, justification string, query_text string"
SUMMARY = "doc_name string, summary string"
#: ``type`` of chunks: as split, after oversized ones are split again, after small ones are merged.
RAW, NO_OVERSIZING, NO_SMALL = "raw", "no_oversizing", "no_small_chunks"


def parsed(schema: str):
    return _parse_datatype_string(schema)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, in its order and types; a missing column is an error."""
    fields = parsed(schema)
    missing = [f.name for f in fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in fields])
