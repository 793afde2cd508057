"""Bottom-k sketches of word shingles: mergeable, for resemblance, containment and distinct counts.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's five-word shingles. The sketch of
a union is the k smallest of both sketches together, so parts can be merged in any order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, batches, grams, released, word_codes

SIZE, WORDS, SPACE = 128, 5, float(2**64)
#: Groups whose sketches a task holds at once.
MOST_HELD = 20_000


def sketch(text: bytes, size: int = SIZE, shingle: int = WORDS) -> np.ndarray:
    """Of fewer words than a shingle has: one hash of all of them; of none: empty."""
    hashes = grams(word_codes(text), shingle)
    if len(hashes) > 4 * size:
        # with enough hashes below a cut, the rest needs no sort; repeats may leave too few distinct ones
        cut = np.partition(hashes, 2 * size)[2 * size]
        low = np.unique(hashes[hashes <= cut])
        if len(low) >= size:
            return low[:size]
    return np.unique(hashes)[:size]


def merge(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.union1d(a, b)[:size]


def distinct(a: np.ndarray, size: int = SIZE) -> float:
    """Estimated number of distinct shingles; exact below ``size``."""
    return float(len(a)) if len(a) < size else (size - 1) * SPACE / float(a[size - 1])


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard likeness; two empty sketches are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = merge(a, b, size)
    return float(np.isin(low, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def containment(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated share of a's shingles that b has; of an empty a: 1."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, size) * distinct(merge(a, b, size), size) / distinct(a, size))


def packed(a: np.ndarray) -> str:
    return a.astype(">u8").tobytes().hex()


def unpacked(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u8").astype(U64)


def sketches(docs: DataFrame, text: str = "text", size: int = SIZE, shingle: int = WORDS) -> DataFrame:
    """Adds ``fingerprint`` (hex) and ``n_shingles`` (estimate) to every row; null text counts as empty."""
    keep = [c for c in docs.columns if c not in ("fingerprint", "n_shingles")]
    inner = docs.select(F.struct(*[docs[c] for c in keep]).alias("row"), docs[text].cast("string").alias("body"))

    def make():
        def work(part: pa.RecordBatch):
            all_of = [sketch(x.as_buffer().to_pybytes() if x.is_valid else b"", size, shingle) for x in part.column(1).cast(pa.binary())]
            yield {"row": part.column(0), "fingerprint": [packed(x) for x in all_of], "n_shingles": [distinct(x, size) for x in all_of]}

        return work

    out = batches(inner, f"row {inner.schema['row'].dataType.simpleString()}, fingerprint string, n_shingles double", make)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "fingerprint", "n_shingles")


def merged(parts: DataFrame, *by: str, fingerprint: str = "fingerprint", size: int = SIZE) -> DataFrame:
    """(by, fingerprint, n_shingles) of the unions that rows of equal ``by`` make: sketches merge in any order.

    Every task merges its own rows first, so a key meets no more rows than there are tasks; null keys are a group like any other, and a null
    fingerprint is empty. An empty table gives no rows; other columns are not read.
    """
    keys = [F.struct(*[parts[c] for c in by]).alias("row")]
    inner = parts.select(*keys, F.to_json(F.struct(*[parts[c] for c in by])).alias("name"), parts[fingerprint].cast("string").alias("own"))
    kind = f"row {inner.schema['row'].dataType.simpleString()}, name string, own string"

    def run(batch_iter):
        held: dict[str, tuple] = {}

        def ready():
            rows, names = pa.concat_arrays([r for r, _ in held.values()]), list(held)
            out = pa.RecordBatch.from_arrays([rows, pa.array(names, pa.string()), pa.array([packed(x) for _, x in held.values()], pa.string())], names=["row", "name", "own"])
            held.clear()
            return out

        for batch in batch_iter:
            for k, (name, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                before = held.get(name)
                held[name] = (before[0] if before else batch.column(0).slice(k, 1), merge(before[1] if before else np.zeros(0, U64), unpacked(own or ""), size))
            if len(held) > MOST_HELD:
                yield ready()
        if held:
            yield ready()
        released()

    ours = inner.mapInArrow(run, kind).repartition("name").sortWithinPartitions("name")
    found = ours.mapInArrow(run, kind)
    # a task may hand a name on twice when it holds too many; the names are sorted, so that only the last one can be
    found = found.groupBy("name").agg(F.first("row").alias("row"), F.collect_list("own").alias("own"))

    def make():
        def work(part: pa.RecordBatch):
            unions = []
            for some in part.column(1).to_pylist():
                total = np.zeros(0, U64)
                for x in some:
                    total = merge(total, unpacked(x), size)
                unions.append(total)
            yield {"row": part.column(0), "fingerprint": [packed(x) for x in unions], "n_shingles": [distinct(x, size) for x in unions]}

        return work

    out = batches(found.select("row", "own"), f"row {inner.schema['row'].dataType.simpleString()}, fingerprint string, n_shingles double", make)
    return out.select(*[F.col("row").getField(c).alias(c) for c in by], "fingerprint", "n_shingles")


def compared(pairs: DataFrame, a: str, b: str, size: int = SIZE) -> DataFrame:
    """Adds resemblance, containment (of ``a`` in ``b``) and n_union of two fingerprint columns to every row; null is an empty fingerprint."""
    keep = [c for c in pairs.columns if c not in ("resemblance", "containment", "n_union")]
    inner = pairs.select(F.struct(*[pairs[c] for c in keep]).alias("row"), pairs[a].cast("string").alias("x"), pairs[b].cast("string").alias("y"))

    def make():
        def work(part: pa.RecordBatch):
            both = [(unpacked(x or ""), unpacked(y or "")) for x, y in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield {"row": part.column(0), "resemblance": [resemblance(x, y, size) for x, y in both], "containment": [containment(x, y, size) for x, y in both], "n_union": [distinct(merge(x, y, size), size) for x, y in both]}

        return work

    out = batches(inner, f"row {inner.schema['row'].dataType.simpleString()}, resemblance double, containment double, n_union double", make)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], "resemblance", "containment", "n_union")


def _ranges(docs: DataFrame, parts: int) -> tuple[list[int], list[tuple[int, int | None]]]:
    """Bounds that deal doc_ids into at most ``parts`` ranges, and each filled range with its largest doc_id.

    Both lists have at most ``parts`` entries, whatever the number of rows.
    """
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] if parts > 1 else None
    bounds = sorted({int(c) for c in cuts or []})
    tops = docs.groupBy(_range_of(bounds).alias("r")).agg(F.max("doc_id").alias("top")).collect()
    return bounds, sorted((x["r"], x["top"]) for x in tops)


def _range_of(bounds: list[int]):
    """0 for the largest ids; ids that are null come last."""
    n = len(bounds)
    if not n:
        return F.lit(0) + F.when(F.col("doc_id").isNull(), 1).otherwise(0)
    above = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), n + 1).otherwise(n - above)


def edited(docs: DataFrame, parts: int | None = None, size: int = SIZE, shingle: int = WORDS) -> DataFrame:
    """Sketches of every text, of its edited text, and their likeness to each other and to the next document.

    The next document is the one after it by descending doc_id (ids that are null last, ties by text); after the
    last comes the first. The edited text has its last third replaced by the start of the next document. Null text
    counts as empty; two empty fingerprints are alike. A lone document is its own next. An empty table gives no rows.

    One shuffle: documents are dealt into ranges of doc_id and read in order; the first document of each range goes
    to the range before it as well.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, tops = _ranges(docs.select("doc_id"), parts)
    # the first document of a range is the next one of the last document of the filled range before it
    wanted = {r: tops[k - 1][0] for k, (r, _) in enumerate(tops)}
    first = {r: top for r, top in tops}
    here = _range_of(bounds)
    also = F.lit(None).cast("int")
    for r, before in wanted.items():
        top = F.col("doc_id").isNull() if first[r] is None else F.col("doc_id") == F.lit(first[r])
        also = F.when((here == r) & top, F.lit(before)).otherwise(also) if len(wanted) <= 64 else also
    if len(wanted) > 64:
        keys = F.create_map(*[F.lit(x) for r, top in tops if top is not None for x in (top, wanted[r])])
        nulls = [wanted[r] for r, top in tops if top is None]
        also = F.when(F.col("doc_id").isNull(), F.lit(nulls[0] if nulls else None).cast("int")).otherwise(keys[F.col("doc_id")])
    dealt = docs.select("doc_id", "text", F.explode(F.filter(F.array(F.struct(here.cast("int").alias("part"), F.lit(0).alias("extra")), F.struct(also.cast("int").alias("part"), F.lit(1).alias("extra"))), lambda x: x["part"].isNotNull())).alias("to"))
    dealt = dealt.select("doc_id", "text", "to.part", "to.extra").repartition("part").sortWithinPartitions("part", "extra", F.col("doc_id").desc_nulls_last(), "text")

    def run(batch_iter):
        held, done = None, None
        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

        def finished(doc, after):
            doc_id, body, own, _ = doc
            cut = len(body) // 3
            changed = (body[: len(body) - cut] + after[1][:cut]).encode()
            other = sketch(changed, size, shingle)
            return doc_id, len(body), hashlib.sha256(changed).hexdigest(), packed(own), packed(other), resemblance(own, other, size), resemblance(own, after[2], size)

        for batch in batch_iter:
            rows = []
            for doc_id, body, part, extra in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if extra and done == part:
                    continue  # rows that tie with the first document of the next range
                body = body or ""
                doc = (doc_id, body, sketch(body.encode(), size, shingle), part)
                if held and held[3] == part:
                    rows.append(finished(held, doc))
                if extra:
                    held, done = None, part
                else:
                    held = doc
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
        released()

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
