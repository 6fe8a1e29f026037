"""Small helpers for Arrow-batched Python stages."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seqloom.runtime import settle


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], dict | pa.RecordBatch | None], schema: str) -> DataFrame:
    """``df`` through ``make``, one Arrow batch at a time; ``make`` returns columns by name."""
    settle(df.sparkSession)
    kind = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = make(batch)
                if out is not None:
                    yield to_batch(out, kind)
        tidy()

    return df.mapInArrow(run, schema)


def map_sorted_groups(df: DataFrame, keys: list[str], make: Callable[[pa.Table], dict | None], schema: str, most_rows: int = 50_000, most_bytes: int = 4 << 20) -> DataFrame:
    """``make`` gets whole groups of ``keys``, several at a time.

    ``df`` must be partitioned by the keys and sorted by them within partitions. Rows are buffered
    until a key changes and the buffer holds ``most_rows`` rows or ``most_bytes`` bytes, so memory is
    bounded by that plus the largest group; callers bound their groups.
    """
    settle(df.sparkSession)
    kind = _arrow_schema(df.sparkSession, schema)

    def cuts(table: pa.Table) -> np.ndarray:
        """Rows at which a new group begins (without row 0)."""
        change = np.zeros(max(0, table.num_rows - 1), dtype=bool)
        for key in keys:
            values = table[key].to_numpy(zero_copy_only=False)
            change |= values[1:] != values[:-1]
        return np.flatnonzero(change) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < most_rows and sum(b.nbytes for b in held) < most_bytes:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = cuts(table)
            if len(starts):
                out = make(table.slice(0, int(starts[-1])))
                if out is not None:
                    yield to_batch(out, kind)
                rest = table.slice(int(starts[-1])).combine_chunks()
                held = rest.to_batches()
                rows = rest.num_rows
        if rows:
            out = make(pa.Table.from_batches(held).combine_chunks())
            if out is not None:
                yield to_batch(out, kind)
        held.clear()
        tidy()

    return df.mapInArrow(run, schema)


def tidy() -> None:
    """Gives back what Arrow and the C library hold for later: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def to_batch(out: dict | pa.RecordBatch, kind: pa.Schema) -> pa.RecordBatch:
    if isinstance(out, pa.RecordBatch):
        return out
    arrays = []
    for field in kind:
        values = out[field.name]
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        if not isinstance(values, pa.Array):
            values = pa.array(values, type=field.type)
        elif values.type != field.type:
            values = values.cast(field.type)
        arrays.append(values)
    return pa.RecordBatch.from_arrays(arrays, schema=kind)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def texts(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """A text column as UTF-8 bytes; null is empty."""
    values = batch.column(name)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (wrapping uint64 arithmetic)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
