"""Arrow batches for operators that need Python: one narrow map, a worker built once a partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import parsed

#: Rows and bytes whose values are Python objects at once.
ROWS, BYTES = 4_096, 4 << 20


def pieces(parts: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[pa.RecordBatch]:
    """Batches in slices of at most ROWS rows and about BYTES of ``columns`` (a row at least), so that a worker holds few texts at once."""
    for part in parts:
        size = np.cumsum(sum((_bytes(part.column(i)) for i in columns), np.ones(part.num_rows, np.int64)))
        at = 0
        while at < part.num_rows:
            end = min(at + ROWS, max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BYTES, "right"))))
            yield part.slice(at, end - at)
            at = end


def _bytes(column: pa.Array) -> np.ndarray:
    """Of each value of a string or list column; the mean for other types."""
    if isinstance(column, (pa.StringArray, pa.ListArray)) and len(column):
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
        each = 1 if isinstance(column, pa.StringArray) else max(1, column.values.nbytes // max(1, len(column.values)))
        return np.diff(offsets) * each
    return np.full(len(column), column.nbytes // max(1, len(column)), np.int64)


def add_columns(df: DataFrame, inputs: list[Column], added: str, make: Callable[[], Callable[..., tuple]], keep: list[str] | None = None) -> DataFrame:
    """Every row with the columns of the DDL ``added``; the worker maps the values of ``inputs`` to theirs.

    Columns of ``df`` with the added names are replaced. The other columns, or those in ``keep``, pass through as one struct, in Arrow.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = parsed(added)
    keep = [c for c in (df.columns if keep is None else keep) if c not in fields.names]
    inner = df.select(F.struct(*[df[c] for c in keep] or [F.lit(0).alias("none")]).alias("row"), *[c.alias(f"in{i}") for i, c in enumerate(inputs)])
    shape, n = to_arrow_schema(fields), len(inputs)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part in pieces(parts, list(range(1, n + 1))):
            rows = [work(*values) for values in zip(*(part.column(i + 1).to_pylist() for i in range(n)))]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), shape)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["row", *shape.names])

    out = inner.mapInArrow(run, f"row {inner.schema['row'].dataType.simpleString()}, {added}")
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *fields.names)
