"""Small helpers the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablegauge.session import apply_session_settings, checkpointed

__all__ = ["apply_session_settings", "bound_bucket", "checkpointed", "free_worker_table", "id_bounds", "read_table", "row_key", "slices", "text_batches", "text_slices", "worker_table"]

#: Bytes of text that a Python task works on at a time.
TEXT_BYTES = 6 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    apply_session_settings(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str | Column) -> Column:
    """128 bits that identify a row by the given columns; nulls count as values.

    Rows equal in these columns share a key, so decisions made by key treat repeated rows alike.
    """
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    flags = [p.isNull() for p in parts]
    return F.struct(F.xxhash64(*flags, *parts).alias("a"), F.xxhash64(F.lit(7), *parts, *flags).alias("b"))


def id_bounds(df: DataFrame, column: str, rows_each: int, most: int = 4096) -> list[int]:
    """Ascending ids that split `df` into ranges of about `rows_each` rows, `most` ranges at most.

    The ids come from one aggregate (a count, then a quantile sketch); the list is the only thing
    that reaches the driver. The ranges set parallelism, never a result.
    """
    rows = df.agg(F.count(column)).first()[0]
    n = min(most, -(-rows // rows_each))
    if n <= 1:
        return []
    shares = [i / n for i in range(1, n)]
    return sorted(set(df.agg(F.percentile_approx(column, shares, 100 * n)).first()[0] or []))


def bound_bucket(column: str, bounds: list[int]) -> Column:
    """Range number of an id: how many bounds are at or below it; a null id is in range 0."""
    if not bounds:
        return F.lit(0)
    # width_bucket over equal steps does not fit unequal ranges; array literals are constant-folded
    edges = F.array(*[F.lit(b).cast("long") for b in bounds])
    found = F.call_function("array_size", F.filter(edges, lambda e: e <= F.col(column)))
    return F.when(F.col(column).isNull(), F.lit(0)).otherwise(found)


_WORKER_TABLES: dict[tuple, object] = {}


def worker_table(key: tuple, make: Callable[[], object]) -> object:
    """A table that a Python worker keeps from task to task, one at a time.

    Spark uses workers again for other stages; asking for another table, or for none, frees the last.
    """
    if key not in _WORKER_TABLES:
        _WORKER_TABLES.clear()
        _WORKER_TABLES[key] = make()
    return _WORKER_TABLES[key]


def free_worker_table() -> None:
    if _WORKER_TABLES:
        _WORKER_TABLES.clear()
        give_back_memory()


def give_back_memory() -> None:
    """Hands freed memory to the system: Arrow and the C library keep it, and workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that what is made of a part at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_slices(batches: Iterable[pa.RecordBatch], column: int, most_bytes: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many bytes in a text column, or of one row.

    What is made of a part then stays small whatever the texts' lengths; and the larger a part,
    the fewer words it shares with others.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(at, end - at)
            give_back_memory()
            at = end


@contextmanager
def text_batches(spark: SparkSession, most_bytes: int = TEXT_BYTES) -> Iterator[None]:
    """Jobs run within send Python batches of about so many bytes, or of one row.

    Spark counts rows alone by default, and 10,000 long texts take many times the memory of short
    ones, in the executor and in Python.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most_bytes))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
