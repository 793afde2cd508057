"""Spans and chunks after splitting: location, gaps, pages, titles, oversized and small chunks.

What works on the spans of one row is a function of Columns. Sequential merges are Python on one document's spans.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import Counter, count_words, page_starts
from .splitters import RecursiveSplitter, Span


def locate(chunks: list[str], text: str) -> list[Span]:
    """Where chunks of unknown origin stand: the last place that touches or overlaps the chunk before, else the first one after."""
    out: list[Span] = []
    before = 0
    for chunk in chunks:
        at = text.rfind(chunk, max(0, before - len(chunk)), before + len(chunk))
        if at < 0:
            at = text.find(chunk, before)
        if at < 0:
            raise ValueError(f"a chunk isn't in the text: {chunk[:60]!r}")
        before = at + len(chunk)
        out.append((at, before))
    return out


def gap_free(spans: Column, size: Column) -> Column:
    """Whether spans in order cover [0, size); they may overlap. No spans cover an empty text."""
    reach = F.aggregate(spans, F.lit(0), lambda end, s: F.when((end < 0) | (s["start"] > end), -1).otherwise(F.greatest(end, s["end"])))
    return F.when(F.size(spans) == 0, size == 0).otherwise(reach == size)


def without_gaps(spans: Column, size: Column) -> Column:
    """A gap goes to the span after it, the rest of the text to the last span."""
    last = F.size(spans) - 1
    ends = lambda i: F.aggregate(F.slice(spans, 1, i), F.lit(0), lambda e, s: F.greatest(e, s["end"]))
    fixed = F.transform(spans, lambda s, i: F.struct(F.when(i == 0, 0).otherwise(F.least(s["start"], ends(i))).alias("start"), F.when(i == last, size).otherwise(s["end"]).alias("end")))
    return F.when(F.size(spans) == 0, spans).otherwise(fixed)


def pages_of(pages: Column, start: Column, end: Column) -> Column:
    """Numbers, ascending, of pages that the span overlaps; an empty page inside it or equal to it counts. ``pages``: as of ``page_starts``."""
    hit = F.filter(pages, lambda p: ~((end <= p["start"]) | (start >= p["end"])) | ((start == p["start"]) & (end == p["end"])))
    return F.array_sort(F.transform(hit, lambda p: p["page"].cast("long")))


def title_context(titles: Column, start: Column, chunk: Column) -> Column:
    """Titles, one a line by level and place, that enclose the chunk's start and don't stand in it."""
    around = F.filter(titles, lambda t: (t["start"] <= start) & (start < t["end"]) & ~F.contains(chunk, t["title"]))
    ordered = F.array_sort(F.transform(around, lambda t: F.struct(t["level"].alias("level"), t["start"].alias("start"), t["title"].alias("title"))))
    return F.array_join(F.transform(ordered, lambda t: t["title"]), "\n")


def annotated(chunks, document: str = "full_text"):
    """Adds chunk_text, chunk_pages and titles_context to rows with start, end, pages and titles of their document."""
    starts = page_starts(F.col("pages"))
    out = chunks.withColumn("chunk_text", F.substring(F.col(document), F.col("start") + 1, F.col("end") - F.col("start")))
    return out.withColumn("chunk_pages", pages_of(starts, F.col("start"), F.col("end"))).withColumn("titles_context", title_context(F.col("titles"), F.col("start"), F.col("chunk_text")))


def split_oversized(text: str, spans: list[Span], splitter: RecursiveSplitter, most: int = 1200, count: Counter = count_words) -> list[Span]:
    """Spans above ``most`` tokens are split again, the others stay."""
    out: list[Span] = []
    for a, b in spans:
        out += [(a + x, a + y) for x, y in splitter.spans(text[a:b])] if count(text[a:b]) > most else [(a, b)]
    return out


def merge_smallest_first(text: str, spans: list[Span], least: int = 100, most: int = 1200, count: Counter = count_words) -> list[Span]:
    """The first small span joins the smaller neighbour that fits (ties: the right one); lengths add up. Until none can."""
    out, sizes = list(spans), [count(text[a:b]) for a, b in spans]
    i = 0
    while i < len(out):
        if sizes[i] < least:
            fits = [k for k in (i + 1, i - 1) if 0 <= k < len(out) and sizes[i] + sizes[k] <= most]
            if fits:
                at = min(i, min(fits, key=sizes.__getitem__))  # of equals, min takes the right one, which comes first
                out[at : at + 2] = [(min(out[at][0], out[at + 1][0]), max(out[at][1], out[at + 1][1]))]
                sizes[at : at + 2] = [sizes[at] + sizes[at + 1]]
                i = 0
                continue
        i += 1
    return out


def merge_to_side(text: str, spans: list[Span], least: int = 100, most: int = 1200, side: str = "next", count: Counter = count_words) -> list[Span]:
    """Small spans join the neighbour on ``side``, else the other one, if the counted sum fits; passes until nothing changes."""
    if side not in ("next", "previous"):
        raise ValueError('side must be "next" or "previous"')
    seen: dict[Span, int] = {}

    def size(s: Span) -> int:
        if s not in seen:
            seen[s] = count(text[s[0] : s[1]])
        return seen[s]

    out, changed = list(spans), True
    while changed:
        changed, i = False, 0
        while i < len(out):
            if size(out[i]) < least:
                for k in (i, i - 1) if side == "next" else (i - 1, i):  # the left one of the two that join
                    if 0 <= k < len(out) - 1 and size(out[k]) + size(out[k + 1]) <= most:
                        out[k : k + 2] = [(min(out[k][0], out[k + 1][0]), max(out[k][1], out[k + 1][1]))]
                        changed = True
                        break
                else:
                    i += 1
            else:
                i += 1
    return out


class Postprocessor:
    """Oversized chunks split, then small ones merged, as one function of a text and its spans."""

    def __init__(self, oversize: RecursiveSplitter | None = None, most: int = 1100, least: int = 100, most_merged: int = 1150, side: str | None = "next", count: Counter = count_words) -> None:
        self.oversize = replace(oversize or RecursiveSplitter(most, 0), count=count)
        self.most, self.least, self.most_merged, self.side, self.count = most, least, most_merged, side, count

    def __call__(self, text: str, spans: list[Span]) -> list[Span]:
        spans = split_oversized(text, spans, self.oversize, self.most, self.count)
        return merge_to_side(text, spans, self.least, self.most_merged, self.side, self.count) if self.side else spans


