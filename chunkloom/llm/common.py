"""What the operators of this subpackage share: batches, hashing and checkpoints."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: a Python worker holds a few of them, whatever the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20
U64 = np.uint64


def tuned(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of this session, so that long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which executors share: that of ``spark.checkpoint.dir``.

    Where none is set, a local session (tests) gets one of its own; a cluster, whose executors couldn't read it, gets an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def strings(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], Iterable[dict | pa.RecordBatch]]]) -> DataFrame:
    """mapInArrow with a worker built once a partition; a worker maps a batch to dicts of columns."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in parts:
            if part.num_rows:
                yield from (to_batch(x, arrow) for x in work(part))
        del work
        released()

    return df.mapInArrow(run, schema)


def released() -> None:
    """Gives the memory of a finished task back: its worker process waits for the next one, beside the workers of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


#: 1 for bytes of white space (U+0009-U+000D and space), for translate.
GAP = bytes(int(b in (9, 10, 11, 12, 13, 32)) for b in range(256))
#: An odd multiplier and its inverse modulo 2^64, and their powers for as many bytes as are hashed together.
BASE, TOGETHER = 0x9E3779B97F4A7C15, 1 << 18
POWERS = np.multiply.accumulate(np.append(U64(1), np.full(TOGETHER - 1, BASE, U64)))
INVERSES = np.multiply.accumulate(np.append(U64(1), np.full(TOGETHER - 1, pow(BASE, -1, 1 << 64), U64)))


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of bytes that aren't white space."""
    gap = np.frombuffer(b"\1" + text.translate(GAP) + b"\1", np.bool_)
    bounds = np.flatnonzero(gap[1:] != gap[:-1])
    return bounds[::2], bounds[1::2]


def word_codes(text: bytes, spans: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """64-bit codes of the words: sums of bytes times powers, all words at once, then mixed.

    A few hundred KB are hashed together, and a longer word by itself, so memory doesn't follow the text's length.
    """
    starts, ends = spans or word_spans(text)
    out, first = np.empty(len(starts), U64), 0
    while first < len(starts):
        at = int(starts[first])
        stop = int(np.searchsorted(ends, at + TOGETHER, "right"))
        if stop <= first:
            out[first] = xxhash.xxh64_intdigest(text[at : int(ends[first])], 1)
            first += 1
            continue
        sums = np.zeros(int(ends[stop - 1]) - at + 1, U64)
        part = np.frombuffer(text, np.uint8, len(sums) - 1, at).astype(U64)
        part += U64(0xD1B54A32D192ED03)
        part *= POWERS[: len(part)]
        np.cumsum(part, out=sums[1:])
        a, b = (starts[first:stop] - at, ends[first:stop] - at) if at or first or stop < len(starts) else (starts, ends)
        out[first:stop] = mixed((sums[b] - sums[a]) * INVERSES[a])
        first = stop
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def grams(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` codes; a shorter sequence gives one hash of all of it, an empty one none."""
    size = min(size, len(codes))
    if not size:
        return np.zeros(0, U64)
    n = len(codes) - size + 1
    out = np.full(n, size, U64)
    for j in range(size):
        out = out * U64(0xD6E8FEB86659FD93) + codes[j : j + n]
    return mixed(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Sets:
    """Union-find over 0..n-1; the root of a set is its smallest member."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unites all pairs at once: hooks larger roots on smaller ones until nothing changes."""
        while len(a):
            up = self.roots()
            x, y = up[a], up[b]
            keep = x != y
            if not keep.any():
                return
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))


def bucket_of(*columns: str, parts: int) -> F.Column:
    return F.pmod(F.xxhash64(*columns), F.lit(parts))
