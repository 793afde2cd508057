"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits in m segments around a ring. If two fingerprints differ in at most t bits, then some
segment starts a chain whose first 1, 2, ..., m segments together differ in at most t/m, 2t/m, ..., t bits. With
m = t + 1 the first segment is equal, which gives the buckets; within a bucket the second is looked up among its at
most one-bit neighbours, and the longer chains prune pairs before the full Hamming distance is taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Sets, batches, checkpoint, popcount, released
from .components import components
from .likeness import named

BITS, SEED, PAIRS = 64, 42, 1 << 20


def _hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of fewer words: of them all; of none: none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U64)
    line, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist())], U64)


def majority(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; of none: zero."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64; no words: zero."""
    return majority(_hashes(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4) -> DataFrame:
    """(key, print) with the fingerprint as a signed 64-bit integer; null text has no words."""

    def make():
        def work(part: pa.RecordBatch):
            # one text at a time, so that a batch of long texts isn't copied at once
            prints = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in part.column(1).cast(pa.binary())]
            yield {key: part.column(0), "print": np.array(prints, U64).view(np.int64)}

        return work

    kind = docs.select(key).schema[0].dataType.simpleString()
    return batches(docs.select(docs[key].alias(key), docs[text].cast("string").alias("body")), f"{key} {kind}, print long", make)


def ring(most: int) -> list[tuple[int, int]]:
    """(start bit from the left, width) of each of the most + 1 segments."""
    cuts = [BITS * i // (most + 1) for i in range(most + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def turned(prints: np.ndarray, start: int) -> np.ndarray:
    return prints if not start else (prints << U64(start)) | (prints >> U64(BITS - start))


def linked(prints: np.ndarray, group: np.ndarray, segment: int, most: int) -> np.ndarray:
    """Roots (positions) of the sets that links within equal ``group`` make; the groups share segment ``segment``."""
    segments = ring(most)
    widths = [segments[(segment + k) % len(segments)][1] for k in range(len(segments))]
    second = widths[1] if len(widths) > 1 else 0
    x = turned(prints, segments[segment][0])
    near = (x << U64(widths[0])) >> U64(BITS - second) if second else np.zeros_like(x)
    order = np.lexsort((near, group))
    x, key = x[order], (group[order].astype(U64) << U64(second)) | near[order]
    sets, n = Sets(len(x)), len(x)
    edges = np.cumsum(widths)

    def check(i: np.ndarray, j: np.ndarray) -> None:
        keep = sets.up[i] != sets.up[j]  # neighbours in one set already need no test
        i, j = i[keep], j[keep]
        diff = x[i] ^ x[j]
        for chain in range(2, len(widths) + 1):
            keep = popcount(diff >> U64(BITS - edges[chain - 1])) <= chain * most // (most + 1) if chain < len(widths) else popcount(diff) <= most
            i, j, diff = i[keep], j[keep], diff[keep]
        sets.join(i, j)
        sets.roots()

    # dense runs: the first of each run gathers what lies near it, so that most pairs of a cluster need no test
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([heads, [n]]))
    if len(heads):
        check(np.repeat(heads, sizes), np.arange(n))
    for flip in [0, *(1 << b for b in range(second))]:
        wanted = key ^ U64(flip)
        low, high = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
        low = np.maximum(low, np.arange(n) + 1)  # each pair once
        count = np.maximum(high - low, 0)
        begin = 0
        total = np.cumsum(count)
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS, "right")))
            for part in range(0, int(count[begin:end].max()), PAIRS) if end == begin + 1 else (0,):
                c = np.minimum(count[begin:end] - part, PAIRS)
                i = np.repeat(np.arange(begin, end), c)
                check(i, np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + low[i] + part)
            begin = end
    out = np.empty(n, np.int64)
    out[order] = order[sets.roots()]
    return out


def links(prints: DataFrame, most: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect whatever differs in at most ``most`` bits.

    Each fingerprint goes to one bucket for each segment. Buckets larger than a partition's share are cut into blocks
    and every pair of blocks becomes a task, so one hot bucket is spread. The table of large buckets has at most
    (most + 1) * 2^width rows, of which only those above the share are kept.
    """
    spark = prints.sparkSession
    segments = ring(most)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    value = lambda start, width: F.shiftrightunsigned(F.shiftleft("print", start) if start else F.col("print"), BITS - width)
    dealt = prints.select("print", F.posexplode(F.array(*[value(*s) for s in segments])).alias("segment", "value"))
    share = max(1024, (most + 1) * prints.count() // parts)
    large = dealt.groupBy("segment", "value").count().filter(F.col("count") > share)
    large = large.select("segment", "value", F.ceil(F.col("count") / share).cast("int").alias("blocks"))
    dealt = dealt.join(F.broadcast(large), ["segment", "value"], "left")
    block = F.pmod(F.xxhash64("print"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    dealt = dealt.select("segment", "value", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "print")
    keys = ["segment", "value", "p", "q"]
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(columns):
            segment, group, prints_ = columns
            for s in np.unique(segment).tolist():
                own = segment == s
                root = linked(p := prints_[own].view(U64), group[own], s, most)
                child = np.flatnonzero(root != np.arange(len(root)))
                if len(child):
                    yield pa.RecordBatch.from_arrays([pa.array(p[x].view(np.int64)) for x in (root[child], child)], names=["a", "b"])

        base = 0
        last = None
        for batch in batch_iter:
            s, v, p, q, f = (batch.column(i).to_numpy() for i in range(5))
            change = np.concatenate([[last is None or last != (s[0], v[0], p[0], q[0])], (np.diff(s) != 0) | (np.diff(v) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)])
            group = base + np.cumsum(change)
            base, last = int(group[-1]), (s[-1], v[-1], p[-1], q[-1])
            held.append((s, group, f))
            if sum(len(x[0]) for x in held) >= 1 << 17:
                columns = [np.concatenate(x) for x in zip(*held)]
                whole = columns[1] < base  # the last group may go on
                yield from flush([c[whole] for c in columns])
                held = [tuple(c[~whole] for c in columns)]
        if held:
            yield from flush([np.concatenate(x) for x in zip(*held)])
        released()

    return dealt.mapInArrow(run, "a long, b long")


def _roots(prints: DataFrame, most: int) -> DataFrame:
    """(print, root) of distinct fingerprints; a root names a component, by one of its fingerprints."""
    roots = components(links(prints.select("print"), most))
    return prints.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 4, most: int = 4) -> DataFrame:
    """(key, fingerprint, component_id) of every row; component_id is the smallest key reachable over links.

    Null and empty texts have no words, so fingerprint zero, and link like any other. Repeated rows and keys give a
    row each. A null key is never the smallest; a component of null keys alone has a null id. Rows with the same
    fingerprint meet only in a partial minimum and in the last join, of two plain exchanges, which Spark can split.
    """
    rows = checkpoint(fingerprints(docs, text, key, shingle))
    own = checkpoint(rows.groupBy("print").agg(F.min(key).alias("least")))
    of_roots = _roots(own, most)
    first = checkpoint(of_roots.groupBy("root").agg(F.min("least").alias("component_id")))
    found = checkpoint(of_roots.join(first, "root").select("print", "component_id"))
    return rows.join(found, "print").select(key, F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, likeness: float = 0.8, most: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each component of near copies: that of the smallest key (null keys last, ties by a hash of the row).

    Near copies are texts whose sets of five-word shingles have a Jaccard likeness of at least ``likeness``, and what such links join; every such
    pair is joined. Fingerprints of the sets within ``most`` bits, found by pigeonring, give the first candidates, prefixes of the sets the others,
    which lie beyond what buckets of fingerprints can find; the whole sets decide. Null and empty texts are copies of each other. Repeated rows leave one; rows that share a key but not a component each stay.
    """
    ident = F.xxhash64(*docs.columns)
    who = F.struct(docs[key].isNull().alias("blank"), docs[key].alias("own_key"), ident.alias("ident"))
    rows = docs.select(who.alias("who"), ident.alias("ident"), docs[text].cast("string").alias("body"))
    groups = named(rows, shingle, likeness, majority, lambda prints: links(prints, most))
    kept = checkpoint(groups.groupBy("root").agg(F.min("who").alias("who")).select(F.col("who.ident").alias("ident")))
    left = docs.select(F.struct(*docs.columns).alias("row"), ident.alias("ident")).join(kept, "ident", "left_semi")
    return left.dropDuplicates(["ident"]).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
