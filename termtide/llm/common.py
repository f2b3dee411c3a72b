"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide.workspace import fresh_dir, shared_dir

# Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z, leaving every other letter alone. Much faster on pure ASCII, so rather
    for words than for texts."""
    translated = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(translated)


def crc_bucket(column: str, buckets: int) -> Column:
    """Remainder of the CRC-32 of an id's decimal text; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % buckets, F.lit(-1))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def use_checkpoint_dir(spark: SparkSession) -> None:
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def slices(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """Consecutive texts in groups of about ``limit`` characters: (index of the first, texts)."""
    first, group, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if group and size + len(text) > limit:
            yield first, group
            first, group, size = i, [], 0
        group.append(text)
        size += len(text)
    if group:
        yield first, group


def parts(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small batches, so that a task never holds all texts of a large one as Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def by_size(batches: Iterator[pa.RecordBatch], limit: int, column: str = "text"
            ) -> Iterator[pa.RecordBatch]:
    """Rows with texts of about ``limit`` bytes."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(), dtype=np.int64)
        lo = 0
        while lo < len(ends):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def give_back() -> None:
    """Return the memory that this process has freed to the system. Arrow and the C library keep it
    otherwise, and an idle worker counts beside the heap of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the worker keeps no memory that it does not use."""
    @functools.wraps(run)
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return freed


def replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """``batch`` with another column ``name``, which may change its type. It has to be there, once."""
    i = batch.schema.get_field_index(name)
    if i < 0:
        raise ValueError(f"no column {name}, or several")
    arrays = list(batch.columns)
    arrays[i] = values
    return pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)
