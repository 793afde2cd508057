"""Embedding near-duplicates by product quantisation, without losing a link.

Unit vectors go to the inverted list of their nearest coarse centroid, with residual codes (one byte a subspace) and
the length of the quantisation error. A query probes every list that can hold a neighbour: moving by the link
distance must reach the plane between its own centroid and the list's. In a list, asymmetric table-lookup distances,
less the stored error, are lower bounds, so they drop pairs safely; the rest is reranked by exact cosine in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sets, batches, checkpoint, released
from .components import components

#: Vectors of the sample that the quantisers are fitted on, SHARE a list if that is more; vectors per coarse list aimed at; most lists.
SAMPLE, SHARE, LIST, LISTS = 16_384, 16, 1_024, 4_096
#: Vector lengths that get quantisers of their own; vectors of rarer lengths are one list each.
LENGTHS = 64
SUBSPACES, CODES, ROUNDS = 8, 64, 8


def lloyd(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


class Quantiser:
    """Coarse centroids and residual codebooks of one dimension."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.coarse = lloyd(sample, lists, rng)
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        rest = sample - self.coarse[self.nearest(sample)]
        self.books = [lloyd(rest[:, a:b], CODES, rng) for a, b in zip(self.cuts, self.cuts[1:])]
        self.apart = np.sqrt(np.maximum(0, ((self.coarse[:, None] - self.coarse[None]) ** 2).sum(2)))

    @classmethod
    def plain(cls, dim: int) -> Quantiser:
        """One list and one code: bounds of zero, so that every pair is reranked."""
        return cls(np.zeros((1, dim)), 1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.coarse.T - 0.5 * (self.coarse**2).sum(1)).argmax(1)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they leave."""
        rest = x - self.coarse[home]
        codes = np.stack([(rest[:, a:b] @ book.T - 0.5 * (book**2).sum(1)).argmax(1) for (a, b), book in zip(zip(self.cuts, self.cuts[1:]), self.books)], axis=1)
        back = np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, home: np.ndarray, reach: float) -> np.ndarray:
        """True where a list can hold a vector within ``reach``."""
        far = -2 * x @ self.coarse.T + (self.coarse**2).sum(1)
        own = far[np.arange(len(x)), home][:, None]
        return far - own <= 2 * (reach + 1e-6) * self.apart[home] + 1e-9

    def bounds(self, x: np.ndarray, cell: int, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances from each query to each member of a list, from lookup tables."""
        rest = x - self.coarse[cell]
        total = np.zeros((len(x), len(codes)))
        for s, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            table = ((rest[:, None, a:b] - self.books[s][None]) ** 2).sum(2)
            total += table[:, codes[:, s]]
        return np.sqrt(total) - error[None]


def unit(x: np.ndarray) -> np.ndarray:
    """In double precision; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes: in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    same = (short == x).all(axis=1).tolist()
    return [a.tobytes() if s else b.tobytes() for s, a, b in zip(same, short, x)]


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    if all(len(r) == 4 * dim for r in rows):
        return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), dim).astype(float)
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * dim else float).astype(float) for r in rows])


def _valid(column: str) -> F.Column:
    """Not null, not empty, only finite components, not all zero."""
    return F.expr(f"{column} is not null and size({column}) > 0 and forall({column}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({column}, x -> x <> 0)")


def near_duplicates(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Rows link if their labels are equal and not null and the cosine is at least ``least`` (over 0). Vectors that are null,
    empty, zero or hold null or non-finite components, and vectors of different lengths, link with nothing: n_links
    0 and the row's own key as component. Equal vectors of a label are one node (named by a 64-bit hash) with a
    multiplicity, so copies cost nothing; they count as links of each other. Repeated keys give a row each; a null
    key is never the smallest, and a component of null keys alone has a null id and is kept.

    Lists larger than a partition's share are cut into blocks of members and of queries; there are at most as many
    such lists as shuffle partitions, so that table is broadcast.
    """
    spark = vectors.sparkSession
    reach = float(np.sqrt(2 - 2 * least))
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[label].alias("label"), vectors[vector].cast("array<double>").alias("vec"))
    rows = rows.withColumn("node", F.when(F.col("label").isNotNull() & _valid("vec"), F.xxhash64("label", "vec")))
    nodes = checkpoint(rows.filter("node is not null").groupBy("node", "label", "vec").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")))
    sizes = nodes.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    quantisers = {}
    for dim, n in sizes:
        lists = int(np.clip(n // LIST, 1, LISTS))
        wanted = max(SAMPLE, SHARE * lists)
        share = min(1.0, wanted / n)
        sample = nodes.filter((F.size("vec") == dim) & (F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select("vec").limit(2 * wanted).toArrow()["vec"]
        x = np.array(sample.to_pylist() or nodes.filter(F.size("vec") == dim).select("vec").limit(256).toArrow()["vec"].to_pylist(), float)
        quantisers[dim] = Quantiser(x / np.linalg.norm(x, axis=1, keepdims=True), lists)
    shared = spark.sparkContext.broadcast(quantisers)

    def make():
        def work(part: pa.RecordBatch):
            node, of, vec, copies = (part.column(i) for i in range(4))
            lengths = np.diff(vec.offsets.to_numpy())
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                raw = vec.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim)
                sent = packed(raw)
                x = unit(raw)
                q = shared.value.get(dim) or Quantiser.plain(dim)
                home = q.nearest(x)
                codes, error = q.encode(x, home)
                row, cell = np.nonzero(q.probes(x, home, reach))
                for member, i, c in ((True, np.arange(len(x)), home), (False, row, cell)):
                    pick = pa.array(at[i])
                    yield {
                        "label": of.take(pick), "dim": np.full(len(i), dim, np.int32), "cell": c.astype(np.int32), "member": np.full(len(i), member), "node": node.take(pick), "copies": copies.take(pick),
                        "x": [sent[k] for k in i.tolist()], "codes": [v.tobytes() for v in codes[i]] if member else [None] * len(i), "error": error[i],
                    }

        return work

    kind = nodes.schema["label"].dataType.simpleString()
    shape = f"label {kind}, dim int, cell int, member boolean, node long, copies long, x binary, codes binary, error double"
    dealt = checkpoint(batches(nodes.select("node", "label", "vec", "copies"), shape, make))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(256, dealt.count() // parts)
    large = dealt.groupBy("label", "dim", "cell").agg(F.count_if("member").alias("m"), F.count_if(~F.col("member")).alias("q")).filter(F.greatest("m", "q") > size)
    large = large.select("label", "dim", "cell", F.ceil(F.col("m") / size).cast("int").alias("m"), F.ceil(F.col("q") / size).cast("int").alias("q"))
    dealt = dealt.join(F.broadcast(large), ["label", "dim", "cell"], "left")
    count = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    own = lambda c: F.array(F.pmod(F.xxhash64("node"), count(c)).cast("int"))
    every = lambda c: F.sequence(F.lit(0), count(c) - 1)
    dealt = dealt.withColumn("mb", F.explode(F.when(F.col("member"), own("m")).otherwise(every("m")))).withColumn("qb", F.explode(F.when(F.col("member"), every("q")).otherwise(own("q"))))
    group = ["label", "dim", "cell", "mb", "qb"]
    # members of a group come before its queries
    dealt = dealt.select(*group, "member", "node", "copies", "x", "codes", "error").repartition(*group).sortWithinPartitions(*group, F.desc("member"))

    def compare(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

        def close(at, members, queries):
            q, cell = shared.value.get(at[1]) or Quantiser.plain(at[1]), at[2]
            node, copies, x, codes, error = (np.concatenate(c) for c in zip(*members)) if members else (np.zeros(0),) * 5
            for qnode, _, qx, _, _ in queries if len(node) else ():
                sets = Sets(len(qnode) + len(node))
                n = np.zeros(len(qnode), np.int64)
                for start in range(0, len(qnode), 256):
                    part = slice(start, start + 256)
                    i, j = np.nonzero(q.bounds(qx[part], cell, codes, error) <= reach + 1e-6)
                    keep = np.einsum("ij,ij->i", qx[part][i], x[j]) >= least
                    i, j = i[keep] + start, j[keep]
                    other = qnode[i] != node[j]
                    np.add.at(n, i[other], copies[j[other]])
                    sets.join(i, j + len(qnode))
                both = np.concatenate([qnode, node])
                root = sets.roots()
                child = np.flatnonzero(both[root] != both)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([qnode[some], both[child]])), pa.array(np.concatenate([n[some], np.zeros(len(child), np.int64)])), pa.array(np.concatenate([qnode[some], both[root[child]]]))], schema=schema)

        at, members, queries = None, [], []
        for batch in batch_iter:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5))))
            member = batch.column(5).to_numpy(zero_copy_only=False)
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(starts, starts[1:]):
                if keys[a] != at:
                    if at:
                        yield from close(at, members, queries)
                    at, members, queries = keys[a], [], []
                for kind_of, into in ((True, members), (False, queries)):
                    i = a + np.flatnonzero(member[a:b] == kind_of)
                    if len(i):
                        pick = pa.array(i)
                        node, copies, x, codes, error = (batch.column(c).take(pick) for c in range(6, 11))
                        into.append((node.to_numpy(), copies.to_numpy(), unit(unpacked(x.to_pylist(), at[1])), np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(i), -1) if kind_of else None, error.to_numpy()))
        if at:
            yield from close(at, members, queries)

        released()

    found = checkpoint(dealt.mapInArrow(compare, "node long, n long, other long"))
    roots = components(found.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    direct = found.filter("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    named = nodes.select("node", "copies", "least").join(direct, "node", "left").join(roots, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "least", F.coalesce("root", "node").alias("root"))
    named = checkpoint(named)
    first = checkpoint(named.groupBy("root").agg(F.min("least").alias("first")))
    named = checkpoint(named.join(first, "root").select("node", "n_links", "first"))
    out = rows.select("id", "node").join(named, "node", "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("first"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def sql(least: float = 0.98) -> str:
    """DuckDB SQL of ``near_duplicates`` over ``embeddings`` with distinct ids."""
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
                         WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
    e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
          WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= {least}),
    reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
    n AS (SELECT a, count(*) AS n FROM e GROUP BY a), m AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m.m, vec_id)) AS component_id, coalesce(m.m, vec_id) >= vec_id AS kept
    FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id"""
