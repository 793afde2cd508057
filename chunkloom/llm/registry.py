"""The queries of this subpackage with their production parameters, and their SQL where there is some."""

from __future__ import annotations

from . import bpe, html, langid, mixing, quality, simhash, sketch, substrings, urls, vectors
from .common import read

#: Host, path and verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

#: Shares of words that the mix aims at, by language.
MIX = {"en": 0.60, "de": 0.15, "fr": 0.15, "es": 0.10}


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return bpe.encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_substrings(spark, sf_dir):
    return substrings.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_embeddings(spark, sf_dir):
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op5_language_id(spark, sf_dir):
    return langid.with_held_out(read(spark, sf_dir, "documents"))


def op6_fingerprints(spark, sf_dir):
    return sketch.edited(read(spark, sf_dir, "documents"))


def op7_html_text(spark, sf_dir):
    return html.extract(read(spark, sf_dir, "pages"))


def op8_quality(spark, sf_dir):
    return quality.classify(read(spark, sf_dir, "documents"), carry=["doc_id"])


def op9_url_filters(spark, sf_dir):
    return urls.judge(read(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


def op10_mixing(spark, sf_dir):
    return mixing.rates(read(spark, sf_dir, "documents"), MIX)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_byte_bpe, op3_substrings, op4_embeddings, op5_language_id, op6_fingerprints, op7_html_text, op8_quality, op9_url_filters, op10_mixing)}
ORACLES = {"op3_substrings": substrings.sql(), "op4_embeddings": vectors.sql(), "op9_url_filters": urls.sql(URL_RULES)}
