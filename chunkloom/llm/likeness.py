"""All pairs of texts whose shingle sets have a Jaccard likeness of t or more: an exact join of sets by prefixes.

Shingles have one order over all texts, rare ones first. If two sets of n and m shingles are alike, they share one of the first
n - ceil(t n) + 1 of the one and m - ceil(t m) + 1 of the other, so the texts meet in the bucket of that shingle. Its places in both sets bound
how many shingles they can share; the pairs that are left are decided by their whole sets. The order is by counts of a sample
and by hash, and changes the work only, not the pairs.

Pairs whose fingerprints are close are candidates as well. Large buckets aren't paired at once: their members are compared with LEADERS of
them first, the same ones in all buckets that they are in, and only members that no link has joined by then go on: first by spanning forests of
the pairs that are left in a bucket, no more of them than members, then by the pairs that are still left. That leaves the components of the links as they are. Likeness is exact but for equal 64-bit hashes of different shingles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Sets, batches, checkpoint, distinct, grams, mixed, popcount, released, word_codes
from .components import components

#: Texts whose shingles are counted for the order, how often a common one is among them, common ones at most.
COUNTED, COMMON, MOST_COMMON = 2_048, 4, 1 << 16
#: Rows of a bucket up to which all pairs are taken at once; leaders of larger ones; pairs tested together.
SMALL_BUCKET, LEADERS, PAIRS = 6, 4, 1 << 20
#: Rounds of spanning forests before all pairs that are left.
FORESTS = 1
#: Bits of the filter that picks the texts whose whole sets are wanted.
FILTER_BITS = 1 << 24
SIZE_BITS = 32
#: Classes of a set's parities: the first that is no less than the set, else the last.
WIDTHS = (1 << 10, 1 << 12, 1 << 14)


def shingles(text: pa.Scalar, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes, in lower case (A-Z); fewer words than a shingle has give one hash of all of them, no words or null none."""
    return distinct(grams(word_codes(text.as_buffer().to_pybytes().lower() if text.is_valid else b""), size))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def prefix(own: np.ndarray, common: np.ndarray, ranks: np.ndarray, likeness: float) -> np.ndarray:
    """The first shingles of a sorted set: those that aren't in sorted ``common`` by hash, then the others by rank."""
    size = len(own) - math.ceil(likeness * len(own) - 1e-9) + 1 if len(own) else 0
    if not len(common):
        return own[:size]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    there = common[at] == own
    rare = own[~there][:size]
    if len(rare) == size:
        return rare
    return np.concatenate([rare, own[there][np.argsort(ranks[at[there]])][: size - len(rare)]])


def possible(m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, likeness: float) -> np.ndarray:
    """Whether sets of m and n shingles whose first shared one is at places i and j can be alike."""
    share = likeness / (1 + likeness) * (m + n) - 1e-9
    return (np.minimum(m, n) >= likeness * np.maximum(m, n) - 1e-9) & (np.minimum(m - i, n - j) >= share)


def _order(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted common shingles of a sample of ``rows`` (ident, body), and their ranks by count."""
    share = min(1.0, COUNTED / max(1, rows.count()))
    drawn = rows.filter(F.pmod(F.xxhash64("ident"), F.lit(1 << 30)) <= int(share * (1 << 30)))

    def make():
        def work(part: pa.RecordBatch):
            keys, n = np.unique(np.concatenate([shingles(x, shingle) for x in part.column(0).cast(pa.binary())]), return_counts=True)
            yield {"s": keys.view(np.int64), "n": n}

        return work

    counts = batches(drawn.select("body"), "s long, n long", make).groupBy("s").agg(F.sum("n").alias("count")).filter(F.col("count") >= COMMON)
    found = counts.orderBy(F.desc("count"), "s").limit(MOST_COMMON).toArrow()
    keys, n = found["s"].to_numpy().view(U64), found["count"].to_numpy()
    ranks = np.empty(len(keys), np.int64)
    ranks[np.lexsort((keys, n))] = np.arange(len(keys))
    sort = np.argsort(keys)
    return keys[sort], ranks[sort]


def _by_bucket(frame: DataFrame, schema: str, pairs_of: Callable[..., Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over whole buckets: ``pairs_of(heads, sizes, *columns)`` of rows that are sorted by s and then by w."""
    dealt = frame.repartition("s").sortWithinPartitions("s", "w")

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(columns):
            s = columns[0]
            if len(s):
                heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
                yield from pairs_of(heads, np.diff(np.concatenate([heads, [len(s)]])), *columns)

        held, rows = [], 0
        for batch in batch_iter:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= 1 << 18 and held[0][0][0] != held[-1][0][-1]:
                columns = [np.concatenate(c) for c in zip(*held)]
                whole = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on
                yield from flush([c[:whole] for c in columns])
                held, rows = [[c[whole:] for c in columns]], len(columns[0]) - whole
        if held:
            columns = [np.concatenate(c) for c in zip(*held)]
            held = []
            yield from flush(columns)
        columns, held = None, []
        released()

    return dealt.mapInArrow(run, schema)


def _unpacked(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return w >> SIZE_BITS, w & ((1 << SIZE_BITS) - 1)


def _met(entries: DataFrame, likeness: float) -> DataFrame:
    """(pair, s, a, b) of entries (s, d, w): possible pairs of nodes a < b; without ``pair`` a member a of a large bucket s, b its size and place."""

    def pairs_of(heads, sizes, s, d, w):
        n, at = _unpacked(w)
        of = np.repeat(np.arange(len(heads)), sizes)
        big = sizes[of] > SMALL_BUCKET

        def out(i, j):
            keep = possible(n[i], n[j], at[i], at[j], likeness)
            a, b = d[i[keep]], d[j[keep]]
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(a), bool)), pa.array(np.zeros(len(a), np.int64)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["pair", "s", "a", "b"])

        for step in range(1, int(sizes[sizes <= SMALL_BUCKET].max(initial=1))):
            i = np.flatnonzero(~big[:-step] & (of[step:] == of[:-step]))
            if len(i):
                yield out(i, i + step)
        i = np.flatnonzero(big)
        if len(i):
            own, starts = of[i], np.flatnonzero(np.concatenate([[True], np.diff(of[i]) != 0]))
            for seed in range(1, LEADERS + 1):
                draw = mixed(d[i].view(U64) ^ U64(seed))
                first = np.lexsort((draw, own))[starts]  # of each bucket the row of least draw
                leader = np.repeat(i[first], np.diff(np.concatenate([starts, [len(i)]])))
                yield out(leader[leader != i], i[leader != i])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(i), bool)), pa.array(s[i]), pa.array(d[i]), pa.array(w[i])], names=["pair", "s", "a", "b"])

    return _by_bucket(entries, "pair boolean, s long, a long, b long", pairs_of)


def spanning(sets: Sets, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of pairs (x, y) that join all the sets which the pairs join, none of them within one set by then. Earlier pairs go first."""
    left, taken = np.arange(len(x)), []
    while len(left):
        up = sets.roots()
        a, b = up[x[left]], up[y[left]]
        differ = a != b
        left, low, high = left[differ], np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        names, first = np.unique(high, return_index=True)  # each root hooks once, on a smaller one
        sets.up[names] = low[first]
        taken.append(left[first])
    return np.concatenate(taken) if taken else left


def _across(members: DataFrame, likeness: float, forest: int | None = None) -> DataFrame:
    """(a, b): pairs of members (s, d, w, root, parity) of a bucket that have different roots and may be alike by places, sizes and parities.

    With ``forest``, which draws their order, only such that join all the roots in a bucket that its pairs join.
    """
    most = (1 - likeness) / (1 + likeness)

    def pairs_of(heads, sizes, s, d, w, root, own):
        n, at = _unpacked(w)
        length = np.fromiter(map(len, own), np.int64, len(own))
        for head, size in zip(heads.tolist(), sizes.tolist()):
            every = np.arange(head, head + size)
            names, name = np.unique(root[every], return_inverse=True)
            if len(names) == 1:
                continue
            sets = Sets(len(names))
            folded = {}
            for width in np.unique(length[every]).tolist():  # sizes ascend, and so do lengths
                wide = every[length[every] >= width]
                folded[width] = wide[0], np.array([fold(own[k], width) for k in wide.tolist()]).view(U64)
            # what can be alike to a row ends where sets are too large
            last = np.searchsorted(n[every], n[every] / likeness + 1e-6, "right")
            rows = max(1, PAIRS // size)
            for k in range(0, size, rows):
                count = np.maximum(last[k : k + rows] - np.arange(k, min(k + rows, size)) - 1, 0)
                i = np.repeat(np.arange(k, k + len(count)), count)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + head
                i += head
                up = sets.roots()[name]
                keep = (up[i - head] != up[j - head]) & possible(n[i], n[j], at[i], at[j], likeness)
                i, j = i[keep], j[keep]
                keep = np.zeros(len(i), bool)
                for width, (first, bits) in folded.items():
                    of = np.flatnonzero(length[i] == width)
                    for part in np.array_split(of, len(of) * width // (1 << 24) + 1):
                        differ = popcount(bits[i[part] - first] ^ bits[j[part] - first]).sum(axis=1, dtype=np.int64)
                        keep[part] = differ <= most * (n[i[part]] + n[j[part]]) + 1e-9
                i, j = i[keep], j[keep]
                if forest is not None:
                    draw = np.argsort(mixed(d[i].view(U64) ^ mixed(d[j].view(U64) + U64(forest))))
                    taken = draw[spanning(sets, name[i[draw] - head], name[j[draw] - head])]
                    i, j = i[taken], j[taken]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(d[i], d[j])), pa.array(np.maximum(d[i], d[j]))], names=["a", "b"])

    return _by_bucket(members, "a long, b long", pairs_of).distinct()


def fold(bits: bytes, size: int) -> np.ndarray:
    """Parities of fewer classes: of so many bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint8).reshape(-1, size), axis=0)


def parity(own: np.ndarray) -> bytes:
    """A bit for each of about as many classes of hashes as the set has: whether an odd number of its hashes are in it."""
    width = next((w for w in WIDTHS if len(own) <= w), WIDTHS[-1])
    return np.packbits(np.bincount((own & U64(width - 1)).astype(np.int64), minlength=width) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Classes that differ in parity: each takes a shingle that only one of the sets has. A longer one is folded to the length of the other."""
    size = min(len(a), len(b))
    return int(popcount(fold(a, size) ^ fold(b, size)).sum())


def _pairs_where(pairs: DataFrame, of: DataFrame, test: Callable[..., bool]) -> DataFrame:
    """The pairs (a, b) for which ``test`` holds of what ``of`` (d, own, and perhaps n) says of the two: test(own of a, own of b, n of a, n of b)."""
    count = F.col("n") if "n" in of.columns else F.lit(0).cast("long")
    side = lambda c: of.select(F.col("d").alias(c), F.col("own").alias(f"{c}_own"), count.alias(f"{c}_n"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_own", "b_own", "a_n", "b_n")

    def make():
        def work(part: pa.RecordBatch):
            keep = [i for i, (x, y, n, m) in enumerate(zip(*(part.column(c) for c in (2, 3)), *(part.column(c).to_pylist() for c in (4, 5)))) if test(x.as_buffer(), y.as_buffer(), n, m)]
            kept = part.take(pa.array(keep, pa.int64()))
            yield {"a": kept.column(0), "b": kept.column(1)}

        return work

    return checkpoint(batches(both, "a long, b long", make))


def _sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(d, own) for ``wanted`` (ident): the whole sets, of one more reading of ``rows`` (ident, body)."""
    spot = F.pmod("ident", F.lit(FILTER_BITS)) + 1  # from 1 on, bucket k holds 32 768 numbers in 4 096 bytes
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in wanted.groupBy(F.bitmap_bucket_number(spot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bits")).collect():
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def make():
        held = shared.value

        def work(part: pa.RecordBatch):
            at = part.column(0).to_numpy() % FILTER_BITS
            body = part.column(1).cast(pa.binary())
            for i in np.flatnonzero(held[at >> 3] >> (at & 7) & 1).tolist():
                own = shingles(body[i], shingle)
                yield {"d": np.array([node(own)]), "own": [own.tobytes()]}

        return work

    sets = checkpoint(batches(rows.select("ident", "body"), "d long, own binary", make).dropDuplicates(["d"]))
    shared.unpersist()
    return sets


def node(own: np.ndarray) -> int:
    """The name of a set."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def _alike(pairs: DataFrame, own: DataFrame, rows: DataFrame, shingle: int, likeness: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that likeness: parities tell most of the others, the whole sets decide."""
    most = (1 - likeness) / (1 + likeness)
    left = _pairs_where(pairs, own.select("d", F.col("parity").alias("own"), "n"), lambda x, y, n, m: differing(x, y) <= most * (n + m) + 1e-9)
    nodes = left.select(F.explode(F.array("a", "b")).alias("d")).distinct()
    sets = _sets(rows, own.join(nodes, "d", "left_semi").select(F.col("who.ident").alias("ident")), shingle)
    return _pairs_where(left, sets, lambda x, y, n, m: jaccard(np.frombuffer(x, U64), np.frombuffer(y, U64)) >= likeness - 1e-12)


def _close(own: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): nodes of one fingerprint with the least of them, and those least ones of fingerprints that ``links`` joins."""
    least = checkpoint(own.groupBy("print").agg(F.min("d").alias("least"), F.count(F.lit(1)).alias("n")))
    same = own.join(least.filter("n > 1"), "print").filter("d <> least").select(F.col("least").alias("a"), F.col("d").alias("b"))
    end = lambda c: least.select(F.col("print").alias(c), F.col("least").alias(f"{c}_least"))
    near = links(least.select("print")).distinct().join(end("a"), "a").join(end("b"), "b")
    return same.union(near.select(F.least("a_least", "b_least").alias("a"), F.greatest("a_least", "b_least").alias("b")))


def named(rows: DataFrame, shingle: int, likeness: float, print_of: Callable[[np.ndarray], int], links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(who, root) of the least ``who`` of every distinct shingle set; equal roots: joined by links of at least ``likeness``.

    ``rows`` has who (a struct that orders rows), ident (a hash of the row, which is who.ident) and body (text). ``print_of`` makes a
    fingerprint of a set, and ``links`` gives edges (a, b) between close ones of a table (print).
    """
    common, ranks = _order(rows, shingle)
    shared = rows.sparkSession.sparkContext.broadcast((common, ranks))

    def make():
        def work(part: pa.RecordBatch):
            sets = [shingles(x, shingle) for x in part.column(1).cast(pa.binary())]
            first = [prefix(x, *shared.value, likeness).view(np.int64) for x in sets]
            yield {"who": part.column(0), "d": list(map(node, sets)), "n": list(map(len, sets)), "parity": list(map(parity, sets)), "print": np.array([print_of(x) for x in sets], U64).view(np.int64), "first": first}

        return work

    of = batches(rows.select("who", "body"), f"who {rows.schema['who'].dataType.simpleString()}, d long, n long, parity binary, print long, first array<long>", make)
    own = checkpoint(of.groupBy("d").agg(F.min("who").alias("who"), *[F.first(c).alias(c) for c in ("n", "parity", "print", "first")]))
    entries = own.select("d", "n", F.posexplode("first").alias("at", "s"))
    entries = entries.select("s", "d", F.shiftleft("n", SIZE_BITS).bitwiseOR(F.col("at").cast("long")).alias("w"))
    met = checkpoint(_met(entries, likeness))
    pairs = checkpoint(met.filter("pair").select("a", "b").union(_close(own.select("d", "print"), links)).distinct())
    members = met.filter("not pair").select("s", F.col("a").alias("d"), F.col("b").alias("w"))
    roots = components(_alike(pairs, own, rows, shingle, likeness))
    rooted = lambda df, c: df.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
    live = checkpoint(rooted(members, "d").select("s", "d", "w", F.col("d_root").alias("root")))
    several = live.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("s")
    live = live.join(several, "s", "left_semi").join(own.select("d", "parity"), "d").select("s", "d", "w", "root", "parity")
    found = rooted(own.select("d", "who"), "d").select("d", "who", F.col("d_root").alias("root"))
    tried, rounds = None, [*range(FORESTS), None]
    while rounds:
        more = _across(live, likeness, draw := rounds.pop(0))
        more = checkpoint(more if draw is not None or tried is None else more.join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            break
        links_ = _alike(more, own, rows, shingle, likeness)
        tried = more if tried is None else tried.union(more)
        true = links_.count()
        if true:
            end = lambda c: found.select(F.col("d").alias(f"{c}_d"), F.col("root").alias(c))  # noqa: E731, B023
            edges = links_.select(F.col("a").alias("a_d"), F.col("b").alias("b_d")).join(end("a"), "a_d").join(end("b"), "b_d")
            last = components(edges).select(F.col("node").alias("root"), F.col("root").alias("last"))
            found, live = (checkpoint(x.join(last, "root", "left").withColumn("root", F.coalesce("last", "root")).select(x.columns)) for x in (found, live))
            if true == more.count():  # all that the buckets' pairs can join is joined
                break
        else:
            rounds = rounds[-1:]
    return found.select("who", "root")
