"""Served items and their display sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termtide import params


def cloud_items(top_words: DataFrame) -> DataFrame:
    """``text, size`` from ``word, score``; the score is truncated to an integer, a larger one
    becomes the largest."""
    size = F.least("score", F.lit(float(2**31 - 1))).cast("int")
    return top_words.select(F.col("word").alias("text"), size.alias("size"))


def unique_spellings(items: DataFrame) -> DataFrame:
    """One item per spelling whatever its case: the largest, then the first in text order."""
    best = F.min(F.struct((-F.col("size")).alias("order"), "text", "size")).alias("best")
    return (
        items.groupBy(F.lower("text").alias("folded")).agg(best)
        .select("best.text", "best.size"))


def display_sizes(items: DataFrame,
                  size_range: tuple[int, int] = params.SIZE_RANGE) -> DataFrame:
    """Add ``font_px``: the square root of ``size`` scaled to ``size_range``, truncated.

    The scale starts at the smallest size, or at 1 if that is 0. Equal sizes all get the
    lower end.
    """
    low, high = size_range
    lo = items.agg(F.min("size")).scalar()
    hi = items.agg(F.max("size")).scalar()

    def root(value: Column) -> Column:
        return F.sqrt(value.cast("double"))

    start = root(F.when(lo == 0, 1).otherwise(lo))
    t = (root(F.col("size")) - start) / F.nullif(root(hi) - start, F.lit(0.0))
    t = F.coalesce(t, F.lit(0.0))
    return items.withColumn("font_px", (low * (1 - t) + high * t).cast("int"))
