"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed pseudo-random position from its content. A source's mix takes each
document a whole number of times, and once more those whose position is below the source's
threshold. Thresholds come from sums of words by source and position bucket, and only the bucket in
which the budget ends is divided further; no documents are sorted, and a larger budget takes a
superset of what a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termtide.llm.common import WORD, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
# Buckets of either histogram; a position has two bucket numbers.
BUCKETS = 4096
# Above this many sources the thresholds are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 100_000


def size_of(text: Column) -> Column:
    """Number of words, as long; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def position_of(doc_id: Column, text: Column) -> Column:
    """24 pseudo-random bits from id and text; equal rows have equal positions."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
                   F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 6), 16, 10).cast("long")


def sized(df: DataFrame) -> DataFrame:
    position = position_of(F.col("doc_id"), F.col("text"))
    return df.select(
        "doc_id", "source", size_of(F.col("text")).alias("size"),
        F.floor(position / BUCKETS).alias("coarse"), (position % BUCKETS).alias("fine"))


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: shares by weight, capped and reshared until none exceeds.

    ``sizes`` has source and size per document. Weights go round the sources by code point, null
    last. A source is capped if it reaches its cap before the water level: in order of
    cap / weight, sources are capped while what is left, by weight, exceeds their cap. The windows
    run over one row a source, summed beforehand.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)),
                          ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int"))
    weighted = sums.select("source", "source_size", weight.cast("long").alias("weight"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"),
                              F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    cap = F.col("source_size") * MAX_REPEATS
    stepped = weighted.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .alias("left_weight"))
    # left / left_weight is the level if this and all later sources are uncapped.
    marked = stepped.withColumn(
        "capped", F.col("left") * F.col("weight") > cap * F.col("left_weight"))
    level = marked.select(
        "*",
        F.min(F.when(~F.col("capped"), F.struct(
            F.col("source_size") / F.col("weight"), F.col("left"), F.col("left_weight"))))
        .over(everything).alias("level"))
    return level.select(
        "source", "source_size",
        F.when(F.col("capped") | F.col("level").isNull(), cap.cast("double"))
        .otherwise(F.col("weight") * (F.col("level.left").cast("double")
                                      / F.col("level.left_weight").cast("double")))
        .alias("target"))


def _ends(sums: DataFrame, bucket: str) -> DataFrame:
    """Per source: the first bucket with which the running sum reaches the budget, and the words
    before it. ``sums``: source, budget, bucket, words; one row a source and bucket."""
    running = Window.partitionBy("source").orderBy(bucket)
    upto = F.sum("words").over(running)
    return sums.select("source", "budget", bucket, "words", upto.alias("upto")).where(
        F.col("upto") >= F.col("budget")).groupBy("source").agg(
        F.min(F.struct(bucket, "words", "upto", "budget")).alias("end")).select(
        "source", F.col("end." + bucket).alias(bucket), F.col("end.words").alias("words"),
        (F.col("end.upto") - F.col("end.words")).alias("before"),
        F.col("end.budget").alias("budget"))


def _by_source(left: DataFrame, right: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Join on source, null equal to null."""
    right = right.withColumnRenamed("source", "right_source")
    on = left["source"].eqNullSafe(right["right_source"])
    return left.join(F.broadcast(right) if small else right, on, how).drop("right_source")


def thresholds(sizes: DataFrame) -> tuple[DataFrame, bool]:
    """source, source_size, target, repeats, coarse_end, fine_end; and whether it is small.

    A document's extra copy is taken if (coarse, fine) is below the two ends. The last piece of
    the budget is rounded to the nearer end of its fine bucket.
    """
    goals = written(targets(sizes), "mix-targets")
    small = goals.count() <= BROADCAST_SOURCES
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    goals = goals.withColumn("repeats", whole).withColumn(
        "budget", F.col("target") - F.col("repeats") * F.col("source_size"))
    budgets = goals.select("source", "budget")
    coarse = sizes.groupBy("source", "coarse").agg(F.sum("size").alias("words"))
    ends = written(_ends(_by_source(coarse, budgets, small), "coarse"), "mix-coarse")
    boundary = ends.select(
        "source", F.col("coarse").alias("coarse_end"),
        (F.col("budget") - F.col("before")).alias("budget"))
    inside = _by_source(sizes, boundary, small).where(F.col("coarse") == F.col("coarse_end"))
    fine = inside.groupBy("source", "budget", "fine").agg(F.sum("size").alias("words"))
    last = _ends(fine, "fine").select(
        "source",
        (F.col("fine") + (F.col("before") + F.col("words") - F.col("budget")
                          <= F.col("budget") - F.col("before")).cast("long")).alias("fine_end"))
    found = _by_source(boundary.select("source", "coarse_end"), last, small)
    return _by_source(goals, found, small, "left").drop("budget"), small


def mix(df: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats for every row of ``df`` (doc_id, source,
    text): how often the mix takes the document.

    The mix has as many words as all documents, shared by weight, no source more than three times.
    Null and empty texts have size 0; a source without words has target 0 and its documents are
    taken 0 times. A null source is a source of its own, the last. Equal rows are taken equally
    often, reruns take the same rows, and other columns of ``df`` do not matter. The result has a row
    for every row of ``df``, taken or not.
    """
    sizes = written(sized(df), "mix-sizes")
    ends, small = thresholds(sizes)
    ends = written(ends, "mix-thresholds")
    extra = (F.col("coarse") < F.col("coarse_end")) | (
        (F.col("coarse") == F.col("coarse_end")) & (F.col("fine") < F.col("fine_end")))
    repeats = F.col("repeats") + F.coalesce(extra, F.lit(False)).cast("long")
    return _by_source(sizes, ends, small).select(
        "doc_id", "source", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.least(repeats, F.lit(MAX_REPEATS))).otherwise(0)
        .cast("long").alias("repeats"))


def taken(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (columns doc_id, source and text among others) as often as the mix takes
    them, with all its columns.

    How often follows from the row itself and its source's threshold, so no join on ids is needed.
    """
    ends, small = thresholds(written(sized(df), "mix-sizes"))
    ends = written(ends, "mix-thresholds").select(
        F.struct("source", "repeats", "coarse_end", "fine_end").alias("mix_end"))
    whole = df.select(F.struct(*df.columns).alias("mix_row")).withColumn(
        "mix_position", position_of(F.col("mix_row.doc_id"), F.col("mix_row.text")))
    on = F.col("mix_row.source").eqNullSafe(F.col("mix_end.source"))
    joined = whole.join(F.broadcast(ends) if small else ends, on)
    extra = F.col("mix_position") < F.col("mix_end.coarse_end") * BUCKETS + F.col("mix_end.fine_end")
    repeats = F.col("mix_end.repeats") + F.coalesce(extra, F.lit(False)).cast("long")
    repeats = F.when(size_of(F.col("mix_row.text")) > 0, F.least(repeats, F.lit(MAX_REPEATS)))
    copies = F.array_repeat(F.lit(True), F.coalesce(repeats, F.lit(0)).cast("int"))
    return joined.select("mix_row", F.explode(copies)).select("mix_row.*")
