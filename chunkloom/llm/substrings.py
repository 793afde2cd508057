"""Substring dedup: words under any window of W consecutive words that starts anywhere else as well.

The suffixes that matter start at anchors: in every window, the k-gram of least hash. Equal windows choose the same
anchor, so their suffixes share a prefix. A longer prefix, of k and half of the window's other words to the roomier side,
is counted over the corpus first; suffixes whose prefix occurs once are leaves of the tree and go no further. The others
are dealt out by prefix. A prefix that too many suffixes share is extended to the whole window, where a count settles it
(its subtree would hang below the depth asked for). In each memory-sized group, the subtree's nodes at depths 1, 2, 4,
..., W are named level by level, from words themselves, not from hashes; nodes at depth W with two leaves or more are the
deep internal nodes, and their leaves are the repeated windows. A group that has outgrown memory all the same goes on by whole windows in its task.

Shuffles: prefixes with a 64-bit document key; texts by that key, once; segments around shared prefixes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, batches, grams, released, word_codes, word_spans

#: Words of an anchor at most; suffixes of a group's prefix at most; words of a batch of groups; remembered keys.
ANCHOR, GROUP, BATCH_WORDS, MEMO = 8, 2_048, 1 << 19, 150_000
#: The bits above a place in a text of up to 2^28 words.
PLACE_ABOVE = ~U64((1 << 28) - 1)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Plan:
    def __init__(self, window: int) -> None:
        self.window, self.k = window, max(1, min(ANCHOR, window // 4))
        self.more = (window - self.k) // 2

    def runs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last window, and prefix key, of each run of windows with the same anchor and side."""
        n = len(codes) - self.window + 1
        if n <= 0:
            return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),)
        anchor = leftmost(grams(codes, self.k), self.window - self.k + 1)
        offset = anchor - np.arange(n)
        left = offset > self.window - self.k - self.more  # too little room to the right
        long = grams(codes, self.k + self.more)
        mark = anchor * 2 + left
        first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        at, side = anchor[first], left[first]
        key = long[np.where(side, at - self.more, at)] * U64(2) + side.astype(U64)
        return first, last, key


def leftmost(hashes: np.ndarray, size: int) -> np.ndarray:
    """Place of the least hash in each run of ``size``, the leftmost of equal ones; by the upper 36 bits."""
    low = (hashes & PLACE_ABOVE) | np.arange(len(hashes), dtype=U64)
    step = 1
    while 2 * step <= size:
        low, step = np.minimum(low[:-step], low[step:]), 2 * step
    if step < size:
        low = np.minimum(low[: len(low) - (size - step)], low[size - step :])
    return (low & ~PLACE_ABOVE).astype(np.int64)


def _prefixes(docs: DataFrame, plan: Plan) -> DataFrame:
    """(spread, h, dk, n): occurrences of prefix keys; the second and later ones in a task need no count elsewhere.

    A task ships the first occurrence of a key with its document, later ones of other documents dealt by document (they
    are known to be shared), and how many those were. So no key has more than a few rows from each task.
    """

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["spread", "h", "dk", "n"])

        def extra():
            rows = [(h, h, None, n - 1) for h, n in seen.items() if n > 1]
            seen.clear()
            for k in range(0, len(rows), 50_000):
                yield batch_of(rows[k : k + 50_000])

        for batch in batch_iter:
            rows = []
            for dk, body in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                keys = plan.runs(word_codes(body.as_buffer().to_pybytes()))[2].view(np.int64).tolist()
                for h, n in Counter(keys).items():
                    if h in seen:
                        rows.append((dk, h, dk, 0))
                    else:
                        rows.append((h, h, dk, 1))
                    seen[h] += n
            if rows:
                yield batch_of(rows)
            if len(seen) > MEMO:
                yield from extra()
        yield from extra()
        released()

    return docs.select("dk", "body").mapInArrow(run, "spread long, h long, dk long, n long")


class Pieces:
    """Turns a document with shared prefixes into segments for the groups, or whole windows where a prefix is too common."""

    def __init__(self, plan: Plan) -> None:
        self.plan = plan
        self.seen: dict[tuple[int, int], int] = {}

    def rows(self, dk: int, d2: int, text: bytes, shared: dict[int, bool]) -> Iterator[tuple]:
        """(g1, g2, dk, d2, start, words, count): count 0: words to compare; 1 or 2: a whole window; 3: g2 settled windows."""
        settled: list[int] = []
        spans = word_spans(text)
        first, last, key = self.plan.runs(word_codes(text, spans))
        w, line = self.plan.window, None
        for a, b, h in zip(first.tolist(), last.tolist(), key.view(np.int64).tolist()):
            common = shared.get(h)
            if common is None:
                continue
            if line is None:  # the words with one space between them, and where each starts there
                line = b" ".join(text.split())
                starts = np.append(np.concatenate([[0], np.cumsum(spans[1] - spans[0] + 1)]), 0)
            if not common:
                yield h, 0, dk, d2, a, line[starts[a] : starts[b + w] - 1], 0
                continue
            for i in range(a, b + 1):
                name = digest(line[starts[i] : starts[i + w] - 1])
                times = self.seen.get(name, 0)
                if not times:
                    yield *name, dk, d2, i, None, 1
                else:
                    if times == 1:
                        yield *name, dk, d2, i, None, 2  # tells the first one, wherever it is
                    settled.append(i)
                self.seen[name] = min(2, times + 1)
            if len(self.seen) > MEMO:
                self.seen.clear()
        if settled:
            at = np.array(settled)
            breaks = np.flatnonzero(np.diff(at) > 1) + 1
            for run in np.split(at, breaks):
                yield dk, len(run), dk, d2, int(run[0]), None, 3


def digest(window: bytes) -> tuple[int, int]:
    """The longest prefix, a whole window: 128 bits of its words' bytes, as two signed integers."""
    x = np.frombuffer(xxhash.xxh3_128_digest(window), np.int64)
    return int(x[0]), int(x[1])


def repeated_windows(segments: list[bytes], window: int) -> list[np.ndarray]:
    """Starts of the windows of each segment (words joined by one space) that occur at least twice among all segments.

    Builds the tree by depth: the name of a node is that of its three parts, so equal names mean equal words.
    """
    if not segments:
        return []
    words = pc.split_pattern(pa.array(segments, pa.large_binary()), " ")
    start = words.offsets.to_numpy()[:-1]
    found = words.values.dictionary_encode()
    name, kinds = found.indices.to_numpy().astype(np.int64), len(found.dictionary)
    ends = np.repeat(words.offsets.to_numpy()[1:], np.diff(words.offsets.to_numpy()))
    at = np.arange(len(name))
    depth = 1

    def deeper(steps: tuple[int, ...], total: int) -> None:
        nonlocal name, kinds, depth
        fit = np.flatnonzero(at + total <= ends)
        key = name[fit]
        for step in steps:
            key = key * kinds + name[fit + step]
        codes, known = pd.factorize(key)
        name = np.full(len(name), -1, np.int64)
        name[fit] = codes
        kinds, depth = max(1, len(known)), total

    while depth < window:
        if depth * 3 <= window and kinds**3 < 1 << 63:
            deeper((depth, depth * 2), depth * 3)
        elif depth * 2 <= window:
            deeper((depth,), depth * 2)
        else:
            deeper((window - depth,), window)
    leaves = np.bincount(name[name >= 0], minlength=1)
    hits = np.flatnonzero((name >= 0) & (leaves[np.maximum(name, 0)] > 1))
    return [h - s for h, s in zip(np.split(hits, np.searchsorted(hits, start[1:])), start.tolist())]


class Group:
    """One group that is too large for a subtree: its suffixes by their longest prefix, whole windows, of which only the first place is held."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.first: dict[tuple[int, int], tuple | None] = {}

    def spans(self, dk: int, d2: int, start: int, words: bytes) -> Iterator[tuple]:
        own = words.split(b" ")
        for i in range(len(own) - self.window + 1):
            name, place = digest(b" ".join(own[i : i + self.window])), (dk, d2, start + i, start + i + self.window)
            if name not in self.first:
                self.first[name] = place
                continue
            if self.first[name]:
                yield self.first[name]
                self.first[name] = None
            yield place


def _spans(dealt: DataFrame, window: int) -> DataFrame:
    """(dk, d2, start, stop): word spans under repeated windows, from rows sorted by (g1, g2)."""

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_words, begin = 0, 0  # words held, and where the last group begins
        out: list[tuple] = []
        lone: tuple | None = None
        last, large = None, None

        def flush(upto: int):
            for (dk, d2, start, _), hits in zip(held[:upto], repeated_windows([h[3] for h in held[:upto]], window)):
                if len(hits):
                    cut = np.flatnonzero(np.diff(hits) > 1)
                    for a, b in zip(hits[np.concatenate([[0], cut + 1])].tolist(), hits[np.concatenate([cut, [len(hits) - 1]])].tolist()):
                        out.append((dk, d2, start + a, start + b + window))
            del held[:upto]

        def ready():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["dk", "d2", "start", "stop"])
            out.clear()
            return batch

        for batch in batch_iter:
            for g1, g2, dk, d2, start, words, count in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (g1, g2) != last:
                    last, lone, large, begin = (g1, g2), None, None, len(held)
                if count == 0 and large:
                    out.extend(large.spans(dk, d2, start, words))
                elif count == 0:
                    held.append((dk, d2, start, words))
                    n_words += words.count(b" ") + 1
                    if n_words > BATCH_WORDS:
                        flush(begin)  # the groups before this one are whole
                        begin, n_words = 0, sum(h[3].count(b" ") + 1 for h in held)
                        if n_words > BATCH_WORDS // 2:
                            large = Group(window)
                            for h in held:
                                out.extend(large.spans(*h))
                            held.clear()
                            n_words = 0
                elif count == 3:
                    out.append((dk, d2, start, start + g2 - 1 + window))
                elif lone is None:
                    lone = (dk, d2, start, start + window)
                else:  # two rows of one window: both are repeated
                    if lone[2] >= 0:
                        out.append(lone)
                    out.append((dk, d2, start, start + window))
                    lone = (0, 0, -1, 0)
            if len(out) > 20_000:
                yield ready()
        flush(len(held))
        if out:
            yield ready()
        released()

    return dealt.mapInArrow(run, "dk long, d2 long, start int, stop int")


def covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    for a, b in spans:
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change[:-1]) > 0


def without(body: bytes, gone: np.ndarray) -> bytes:
    """The text without those words, each with the white space after it."""
    out, at = [], 0
    spans = [m.span() for m in WORD.finditer(body)]
    for i, (a, b) in enumerate(spans):
        if gone[i]:
            out.append(body[at:a])
            at = spans[i + 1][0] if i + 1 < len(spans) else len(body)
    return b"".join([*out, body[at:]])


def dedup(docs: DataFrame, window: int = 35, text: str = "text", replace: bool = False) -> DataFrame:
    """Adds n_words, n_removed and kept_sha256 (of the kept words, joined by spaces) to every row, or replaces its text.

    Words are runs of anything but space and U+0009-U+000D, unchanged; null text has none. Each word under a window of
    ``window`` words whose words also start anywhere else (same document included) is removed; texts shorter than a window keep all.
    Repeated rows are separate documents, so they repeat each other. Keys play no part, so they may be null or repeated. With ``replace``
    the columns stay as they are, but the text loses its removed words; null stays null.
    """
    assert window >= 2
    plan = Plan(window)
    names = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256")]
    row = F.struct(*[docs[c] for c in names if c != text])
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    # two hashes name a text, so copies have one result; a task hands on two copies of a text at most, which tell that it has others
    base = docs.select(F.xxhash64(body).alias("dk"), F.xxhash64(F.lit("second"), body).alias("d2"), row.alias("row"), docs[text].cast("string").alias("body"))

    # dealt once, read twice: both branches need all columns, so that Spark reuses the exchange
    found = _prefixes(base.select("dk", F.coalesce("body", F.lit("")).alias("body")), plan).repartition("spread")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    totals = found.groupBy("spread").agg(F.sum("n").alias("total"), F.coalesce(F.max("h"), F.max("dk")).alias("some")).filter((F.col("total") > GROUP) & F.col("some").isNotNull())
    # beyond the k most common prefixes, none has more than 1/k of all suffixes: k rows bound every group
    common = totals.orderBy(F.desc("total"), "spread").limit(4 * parts).select(F.col("spread").alias("h"), F.lit(True).alias("common"))
    marks = found.withColumn("total", F.sum("n").over(Window.partitionBy("spread"))).filter("dk is not null and (n = 0 or total > 1)")
    marks = marks.select("dk", "h").join(F.broadcast(common), "h", "left")
    marks = marks.groupBy("dk").agg(F.collect_set(F.struct("h", F.coalesce("common", F.lit(False)).alias("common"))).alias("shared"))

    def cut(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, copies = Pieces(plan), Counter()
        for batch in batch_iter:
            rows: list[tuple] = []
            for dk, d2, text_, shared in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).cast(pa.binary()), batch.column(4).to_pylist()):
                copies[dk, d2] += 1
                if copies[dk, d2] > 2 or not text_.is_valid:
                    continue
                rows += pieces.rows(dk, d2, text_.as_buffer().to_pybytes(), {x["h"]: x["common"] for x in shared})
                if len(rows) > 20_000:
                    yield _segment_batch(rows)
                    rows = []
            if rows:
                yield _segment_batch(rows)
            if len(copies) > MEMO:
                copies.clear()
        released()

    # the same columns as in the last join below: the texts are dealt once
    segments = base.join(marks, "dk").select("dk", "d2", "row", "body", "shared").mapInArrow(cut, "g1 long, g2 long, dk long, d2 long, start int, words binary, count int")
    spans = _spans(segments.repartition("g1", "g2").sortWithinPartitions("g1", "g2"), window)
    spans = spans.groupBy("dk").agg(F.collect_set(F.struct("d2", "start", "stop")).alias("spans"))

    done = base.join(spans, "dk", "left")
    kind = base.schema["row"].dataType.simpleString()

    def make():
        def work(part: pa.RecordBatch):
            columns: list[list] = [[], [], [], []]
            for d2, text_, own in zip(part.column(1).to_pylist(), part.column(2).cast(pa.binary()), part.column(3).to_pylist()):
                raw = text_.as_buffer().to_pybytes() if text_.is_valid else b""
                words = raw.split()
                gone = covered(len(words), [(s["start"], s["stop"]) for s in own or [] if s["d2"] == d2])
                n = int(gone.sum())
                left = [x for x, g in zip(words, gone.tolist()) if not g] if n else words
                new = None if not text_.is_valid else without(raw, gone).decode() if n and replace else text_.as_py().decode() if replace else None
                for c, v in zip(columns, (len(words), n, hashlib.sha256(b" ".join(left)).hexdigest(), new)):
                    c.append(v)
            yield {"row": part.column(0), "n_words": columns[0], "n_removed": columns[1], "kept_sha256": columns[2], "body": columns[3]}

        return work

    out = batches(done.select("row", "d2", "body", "spans"), f"row {kind}, n_words long, n_removed long, kept_sha256 string, body string", make)
    of = lambda c: F.col("body").alias(text) if c == text else F.col("row").getField(c).alias(c)
    if replace:
        return out.select(*map(of, names))
    return out.select(*[of(c) for c in names if c != text], "n_words", "n_removed", "kept_sha256")


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["g1", "g2", "dk", "d2", "start", "words", "count"])


def sql(window: int = 35) -> str:
    """DuckDB SQL of ``dedup`` over (doc_id, text) of ``documents``."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    win AS (SELECT r, i, array_to_string(list_slice(w, i, i + {window - 1}), ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
    rep AS (SELECT r, i FROM win JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) USING (s)),
    words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
    marked AS (SELECT words.r, words.i, x, max(CASE WHEN rep.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY words.r ORDER BY words.i ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) AS gone
               FROM words LEFT JOIN rep ON rep.r = words.r AND rep.i = words.i),
    done AS (SELECT r, sum(gone) AS n, string_agg(x, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN done USING (r)"""
