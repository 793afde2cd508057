"""Text functions as columns, and the token counters that operators take."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

Counter = Callable[[str], int]


#: Runs of letters, digits and underscores: terms of lower-cased texts.
TERM = re.compile(r"\w+")


def count_words(text: str) -> int:
    """The default token counter: words between white space."""
    return len(text.split())


@lru_cache(4)
def _ranks(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class BpeCounter:
    """Counts byte-level BPE tokens by a rank file; the vocabulary is read once a worker."""

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern

    def __call__(self, text: str) -> int:
        return len(_ranks(self.path, self.pattern).encode_ordinary(text))


def n_words(text: Column) -> Column:
    """``count_words`` as a column."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def domain_of(name: Column) -> Column:
    """What stands before the first underscore."""
    return F.substring_index(name, "_", 1)


def stem(path: Column) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(F.url_decode(path), r"([^/]*)$", 1), r"\.[^.]*$", "")


def is_confidently_foreign(guesses: Column, home: str = "en", least: float = 0.98) -> Column:
    """Whether the likeliest of ``guesses`` (array of struct<lang, prob>) is another language with enough confidence; false if there is none."""
    best = F.array_max(F.transform(guesses, lambda g: F.struct(g["prob"].alias("prob"), g["lang"].alias("lang"))))
    return F.coalesce((best["prob"] >= least) & (best["lang"] != home), F.lit(False))


def gate(detect: Callable[[str], list[tuple[str, float]]], home: str = "en", least: float = 0.98, chars: int = 50_000) -> Callable[[str], bool]:
    """The same test for a detector on driver or worker: looks at the first ``chars`` characters; a detector that fails keeps the text."""

    def foreign(text: str) -> bool:
        try:
            guesses = detect(text[:chars])
        except Exception:  # noqa: BLE001  detectors raise errors of their own on texts without features
            return False
        if not guesses:
            return False
        lang, prob = max(guesses, key=lambda g: g[1])
        return lang != home and prob >= least

    return foreign


def escaped(text: Column) -> Column:
    """For display: HTML special characters, and line breaks as ``<br>``."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def shown(value: Column, kind: str) -> Column:
    """A number as text: seconds ("s"), a rounded integer ("int", half to even), or percent ("%"); null is N/A."""
    text = {"s": F.format_string("%.3f s", value.cast("double")), "int": F.bround(value, 0).cast("long").cast("string"), "%": F.format_string("%.2f%%", value.cast("double") * 100)}[kind]
    return F.coalesce(F.when(value.isNotNull() & ~F.isnan(value.cast("double")), text), F.lit("N/A"))


def plus_minus(mean: Column, deviation: Column) -> Column:
    """Percent, mean ± deviation; a missing deviation shows the mean alone."""
    both = F.format_string("%.2f ± %.2f", mean * 100, deviation * 100)
    return F.when(mean.isNull(), "N/A").when(deviation.isNull(), F.format_string("%.2f", mean * 100)).otherwise(both)


def page_starts(pages: Column) -> Column:
    """array<struct<page, start, end>> of pages in order; offsets in code points of the joined text."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<page:int,start:int,end:int>>)").alias("out"))

    def add(state: Column, page: Column) -> Column:
        end = state["at"] + F.length(F.coalesce(page["text"], F.lit("")))
        one = F.struct(page["page"].cast("int").alias("page"), state["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    return F.aggregate(pages, zero, add, lambda s: s["out"])


REGEX_TAG = re.compile(r"<regex>\s*(.+?)\s*</regex>", re.I | re.S)


def regex_in(answer: str | None) -> str | None:
    """The first ``<regex>`` of a model's answer if it compiles, once with hyphens inside character classes escaped; else none."""
    found = REGEX_TAG.search(answer or "")
    if not found:
        return None
    plain = found[1]
    for pattern in (plain, re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"(?<!\\)-", r"\\-", m[0]), plain)):
        try:
            re.compile(pattern)
        except re.error:
            continue
        return pattern
    return None
