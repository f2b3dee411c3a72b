"""A sketch that names its heavy hitters: cells, candidates and total as one mergeable record.

Every task reads its words once and keeps the cells of a count-min sketch, the total, and the counters of
Misra and Gries ("Finding repeated elements", Sci. Comput. Program. 2, 1982), merged batch by batch
as in Agarwal et al. ("Mergeable summaries", PODS 2012). None of them grows with the vocabulary. A word
that makes up ``pct`` of all tokens makes up as much of those of some task, where its counter survives, so
the candidates hold every heavy hitter.

A record is a table of at most cells + candidates + 1 rows per part: ``kind, word, r, b, n``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termtide import params, workspace
from termtide.operators.sketch import cms_estimates, depth_of, width_of

CELL, CANDIDATE, TOTAL = "cell", "candidate", "total"
RECORD = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("word", T.StringType()),
    T.StructField("r", T.IntegerType()),
    T.StructField("b", T.LongType()),
    T.StructField("n", T.LongType()),
])
# Words whose cells a task remembers.
KNOWN = 100_000
# Rows, and bytes of them, that a task counts at once.
ROWS, BYTES = 2_000_000, 64 << 20


def _summaries(eps: float, delta: float, seed: int, pct: float):
    width, depth, size, known_limit = width_of(eps), depth_of(delta), math.ceil(1 / pct), KNOWN
    rows_limit, bytes_limit = ROWS, BYTES
    kinds, names = (CELL, CANDIDATE, TOTAL), RECORD.fieldNames()

    # A local function, so that it is shipped to the executors by value.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(depth * width, np.int64)
        counters: dict[str, int] = {}
        known: dict[str, bytes] = {}  # the first words, frequent ones among them
        prefixes = [f"{seed}:{r}:".encode() for r in range(depth)]
        starts = np.arange(depth) * width

        def hashes(word: str) -> bytes:
            found = known.get(word)
            if found is None:
                data = word.encode("utf-8", "surrogatepass")
                found = b"".join([hashlib.md5(p + data).digest()[:4] for p in prefixes])
                if len(known) < known_limit:
                    known[word] = found
            return found

        def gathered() -> Iterator[pa.Table]:
            held, rows, size_of = [], 0, 0
            for batch in batches:
                held.append(batch)
                rows, size_of = rows + batch.num_rows, size_of + batch.nbytes
                if rows >= rows_limit or size_of >= bytes_limit:
                    yield pa.Table.from_batches(held)
                    held, rows, size_of = [], 0, 0
            if held:
                yield pa.Table.from_batches(held)

        total = 0
        for table in gathered():
            counted = pc.value_counts(table.column("word").drop_null())
            words, n = counted.field("values").to_pylist(), counted.field("counts").to_numpy()
            total += int(n.sum())
            found = np.frombuffer(b"".join(map(hashes, words)), ">u4").reshape(-1, depth)
            np.add.at(cells, found % width + starts, n[:, None])
            for word, count in zip(words, n.tolist(), strict=True):
                counters[word] = counters.get(word, 0) + count
            if len(counters) > size:
                # The largest one that has to go takes as much from all the others.
                values = np.fromiter(counters.values(), np.int64, len(counters))
                least = int(np.partition(values, -size - 1)[-size - 1])
                counters = {w: c - least for w, c in counters.items() if c > least}
        used = np.flatnonzero(cells)
        rows = [*counters.items()]
        words, n = [w for w, _ in rows], [c for _, c in rows]
        yield pa.RecordBatch.from_arrays([
            pa.array([kinds[0]] * len(used) + [kinds[1]] * len(rows) + [kinds[2]], pa.string()),
            pa.array([None] * len(used) + words + [None], pa.string()),
            pa.array([*(used // width).tolist(), *[None] * len(rows), None], pa.int32()),
            pa.array([*(used % width).tolist(), *[None] * len(rows), None], pa.int64()),
            pa.array([*cells[used].tolist(), *n, total], pa.int64())], names=names)
    return run


def _written(record: DataFrame) -> DataFrame:
    """The record as a table, which is small and read several times."""
    path = workspace.fresh_dir(record.sparkSession, "summary")
    record.write.parquet(path)
    return record.sparkSession.read.schema(RECORD).parquet(path)


def cells_of(record: DataFrame) -> DataFrame:
    """``r, b, c``, as ``cms_cells`` gives them."""
    return record.where(F.col("kind") == CELL).select("r", "b", F.col("n").alias("c"))


def total_of(record: DataFrame) -> DataFrame:
    """One row ``total``: the tokens that went into the record."""
    return record.where(F.col("kind") == TOTAL).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))


def heavy_hitters_of(record: DataFrame, pct: float = params.HEAVY_HITTERS_PCT, *,
                     eps: float = params.EPS, delta: float = params.DELTA,
                     seed: int = params.SEED) -> DataFrame:
    """``word, est`` of the candidates whose estimate is at least ``pct`` of the total.

    Every word that makes up ``pct`` of all tokens is among them. The parameters are those
    of the record; a larger ``pct`` is allowed.
    """
    candidates = record.where(F.col("kind") == CANDIDATE).select("word", "n")
    estimates = cms_estimates(candidates, cells_of(record), eps=eps, delta=delta, seed=seed)
    return estimates.where(F.col("est") >= F.lit(pct) * total_of(record).scalar()).select("word", "est")


def _summed(parts: DataFrame, pct: float, **parameters) -> DataFrame:
    summed = _written(parts.groupBy("kind", "word", "r", "b").agg(F.sum("n").alias("n")).select(
        RECORD.fieldNames()))
    # Candidates that are no heavy hitters by estimate cannot be of the words above the threshold.
    kept = heavy_hitters_of(summed, pct, **parameters).select("word")
    candidates = summed.where(F.col("kind") == CANDIDATE).join(kept, "word", "left_semi")
    return _written(summed.where(F.col("kind") != CANDIDATE).unionByName(
        candidates.select(RECORD.fieldNames())))


def summary(words: DataFrame, pct: float = params.HEAVY_HITTERS_PCT, *, eps: float = params.EPS,
            delta: float = params.DELTA, seed: int = params.SEED) -> DataFrame:
    """The record of the rows of ``words`` (word), made in one pass and merged.

    Null words are left out. An empty table gives a record with total 0. The work is done by the call.
    """
    parts = words.select("word").mapInArrow(_summaries(eps, delta, seed, pct), RECORD)
    return _summed(parts, pct, eps=eps, delta=delta, seed=seed)


def merge_summaries(a: DataFrame, b: DataFrame, pct: float = params.HEAVY_HITTERS_PCT, *,
                    eps: float = params.EPS, delta: float = params.DELTA,
                    seed: int = params.SEED) -> DataFrame:
    """The record of both inputs from two records with the same parameters.

    A word above the threshold of the whole is above that of one part, so it stays a candidate.
    """
    return _summed(a.select(RECORD.fieldNames()).unionByName(b.select(RECORD.fieldNames())), pct,
                   eps=eps, delta=delta, seed=seed)
