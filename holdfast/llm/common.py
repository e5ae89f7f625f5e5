"""What the operators share: reading a table, and tables written to the shared folder."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: Bytes of text that one step of a task works on; a single longer text is a step of its own.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the folder that all executors share: computed once, safe when executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, wanted: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def sha_list(parts: Column) -> Column:
    """Lowercase hex of the SHA-256 of comma-joined strings."""
    return F.sha2(F.array_join(parts, ",").cast("binary"), 256)


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with their texts as bytes (null as empty), each slice of about `size` bytes; only the texts of
    one slice are held."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        taken = lambda a, b: [t or b"" for t in column.slice(a, b - a).to_pylist()]  # noqa: B023, E731
        first, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
            if held and held + n > size:
                yield batch.slice(first, i - first), taken(first, i)
                first, held = i, 0
            held += n + 1
        if first < batch.num_rows:
            yield batch.slice(first), taken(first, batch.num_rows)


def crc(data: bytes | memoryview) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, one value after the other, and the offsets of the values in them."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with about `size` bytes in a binary column, a longer value in a slice of its own."""
    for batch in batches:
        _, offsets = binary_parts(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
            yield batch.slice(first, last - first)
            first = last
