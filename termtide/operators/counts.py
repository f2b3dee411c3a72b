"""Exact counts per word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide.functions.porter import with_stem


def word_counts(words: DataFrame) -> DataFrame:
    """``word, n``; works on a batch and on a stream."""
    return words.groupBy("word").agg(F.count("*").alias("n"))


def merge_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add two tables of counts; an empty one changes nothing."""
    return old.unionByName(new).groupBy("word").agg(F.sum("n").alias("n"))


def stemmed(counts: DataFrame) -> DataFrame:
    """Counts by stem, several rows per stem. The stems are still to be summed."""
    return with_stem(counts.select("word", "n")).select(F.col("stem").alias("word"), "n")


def stem_counts(counts: DataFrame) -> DataFrame:
    """Counts by stem: every distinct word is stemmed once, and the counts are added."""
    return stemmed(counts).groupBy("word").agg(F.sum("n").alias("n"))


def total_words(counts: DataFrame) -> DataFrame:
    """One row: the number of counted tokens."""
    return counts.agg(F.sum("n").alias("total"))
