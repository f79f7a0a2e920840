"""What the operators share: staged tables, text buffers, hashes."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.staging import shared_dir, staged, unstaged

#: Bytes of a batch that goes to a worker, and Spark's own setting, which this replaces.
BATCH_BYTES, SPARK_BATCH_BYTES = 4 << 20, "67108864b"

__all__ = ["byte_rows", "crc_mod", "crc_mod_value", "free_name", "in_batches", "in_pieces", "release", "shared_dir", "staged", "unstaged"]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal text of doc_id, modulo n. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def crc_mod_value(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def release() -> None:
    """Give memory that a task has freed back to the system: workers live on for later tasks, beside the executor's own heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def in_batches(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """rows.mapInArrow(run, schema) with batches of BATCH_BYTES, as texts may be long; a session that has its own limit keeps it."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == SPARK_BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return rows.mapInArrow(run, schema)


def free_name(name: str, columns: list[str]) -> str:
    """The name, with underscores after it until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_rows(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_pieces(batch: pa.RecordBatch, column: str, at_most: int = 4_000_000):
    """Slices of a batch with about at_most bytes of the column each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > at_most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)
