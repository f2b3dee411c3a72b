"""Heavy hitters and the first K words."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termtide import params
from termtide.operators.counts import total_words
from termtide.operators.sketch import cms_cells, cms_estimates


def heavy_hitters(counts: DataFrame, pct: float = params.HEAVY_HITTERS_PCT) -> DataFrame:
    """Words that make up at least ``pct`` of all tokens."""
    total = total_words(counts).scalar()
    return counts.where(F.col("n") >= F.lit(pct) * total)


def heavy_hitters_cms(counts: DataFrame, pct: float = params.HEAVY_HITTERS_PCT, *,
                      eps: float = params.EPS, delta: float = params.DELTA,
                      seed: int = params.SEED) -> DataFrame:
    """``word, est`` of the words whose sketch estimate is at least ``pct`` of all tokens."""
    if eps > pct:
        warnings.warn(
            f"the sketch error eps={eps} exceeds the threshold pct={pct}: words below the "
            "threshold will pass", stacklevel=2)
    parameters = {"eps": eps, "delta": delta, "seed": seed}
    estimates = cms_estimates(counts, cms_cells(counts, **parameters), **parameters)
    total = total_words(counts).scalar()
    return estimates.where(F.col("est") >= F.lit(pct) * total).select("word", "est")


def list_size(k: int | None) -> int:
    return params.TOP_K_UNSET if k is None else k


def top_k(counts: DataFrame, k: int | None = params.TOP_K, by: str = "n") -> DataFrame:
    """``word, score`` of the ``k`` largest counts, 25 if ``k`` is None; ties in word order."""
    return (
        counts.orderBy(F.desc(by), F.asc("word")).limit(list_size(k))
        .select("word", F.col(by).cast("double").alias("score")))


def top_heavy_hitters(partial_counts: DataFrame, k: int | None = params.TOP_K,
                      pct: float = params.HEAVY_HITTERS_PCT) -> DataFrame:
    """``word, score`` of the first ``k`` heavy hitters, in one pass over the counts.

    ``partial_counts`` may hold several rows per word. One rollup gives the sums per word and
    the total, so the counts, perhaps the state of a running stream, are read once. The
    threshold is a lower bound on the count, so it may follow the limit.
    """
    ranked = (
        partial_counts.rollup("word")
        .agg(F.sum("n").alias("n"), F.grouping("word").alias("is_total"))
        .orderBy(F.desc("is_total"), F.desc("n"), F.asc("word"))
        .limit(list_size(k) + 1))
    total = F.max(F.when(F.col("is_total") == 1, F.col("n"))).over(
        Window.partitionBy(F.lit(0)))  # over at most k + 1 rows
    return (
        ranked.withColumn("total", total)
        .where((F.col("is_total") == 0) & (F.col("n") >= F.lit(pct) * F.col("total")))
        .orderBy(F.desc("n"), F.asc("word"))
        .select("word", F.col("n").cast("double").alias("score")))
