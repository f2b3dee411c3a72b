"""Count-min sketch as a table of cells.

Row ``r`` of the sketch hashes every word to one of ``width`` buckets ``b`` and adds its count
there. The cells of two sketches are merged by adding them, and a word's estimate is its smallest
cell, which is never below its count (Cormode and Muthukrishnan, "An improved data stream
summary", J. Algorithms 55, 2005).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termtide import params

# Above this many cells (64 bytes each, 64 MiB in all) the sketch is joined by shuffle.
BROADCAST_CELLS = 1_000_000


def width_of(eps: float) -> int:
    return math.ceil(math.e / eps)


def depth_of(delta: float) -> int:
    return math.ceil(math.log(1 / delta))


def _with_cells(counts: DataFrame, eps: float, delta: float, seed: int) -> DataFrame:
    """``word, n, r, b``: one row per word and sketch row."""
    def bucket(r: int) -> Column:
        digest = F.md5(F.concat(F.lit(f"{seed}:{r}:"), F.col("word")))
        return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("bigint") % width_of(eps)

    cells = F.array(*[
        F.struct(F.lit(r).alias("r"), bucket(r).alias("b")) for r in range(depth_of(delta))])
    return counts.select("word", "n", F.inline(cells))


def cms_cells(counts: DataFrame, *, eps: float = params.EPS, delta: float = params.DELTA,
              seed: int = params.SEED) -> DataFrame:
    """Sketch of ``counts``: ``r, b, c``.

    The sketch is linear, so a word is added once with its count, not once per token.
    """
    return (
        _with_cells(counts, eps, delta, seed)
        .groupBy("r", "b").agg(F.sum("n").alias("c")))


def merge_cells(a: DataFrame, b: DataFrame) -> DataFrame:
    """Add two sketches made with the same parameters."""
    return a.unionByName(b).groupBy("r", "b").agg(F.sum("c").alias("c"))


def cms_estimates(counts: DataFrame, cells: DataFrame, *, eps: float = params.EPS,
                  delta: float = params.DELTA, seed: int = params.SEED) -> DataFrame:
    """``word, n, est`` for every word of ``counts``, also for words the sketch never saw.

    The parameters bound the number of cells, which decides whether they are broadcast.
    Counts that come from a ``groupBy("word")`` then stay in place up to the minimum. A larger
    sketch is joined by cell, which spreads words evenly whatever their counts.
    """
    small = width_of(eps) * depth_of(delta) <= BROADCAST_CELLS
    cell = F.coalesce(F.col("c"), F.lit(0))
    return (
        _with_cells(counts, eps, delta, seed)
        .join(F.broadcast(cells) if small else cells, ["r", "b"], "left")
        .groupBy("word", "n").agg(F.min(cell).alias("est")))
