"""The published list of top words: a small table that readers never see half-written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide import schemas
from termtide.operators.display import cloud_items
from termtide.sources import publications


def write_snapshot(top_words: DataFrame, path: str, *, keep: int = publications.KEEP) -> None:
    """Publish ``word, score``, at most K rows; an empty list leaves the last snapshot in place."""
    publications.publish(top_words.select("word", "score").coalesce(1), f"{path}/live", keep=keep,
                         skip_empty=True)


def read_top_words(spark: SparkSession, path: str) -> DataFrame:
    """``word, score`` of the newest snapshot, in no particular order."""
    return publications.newest(spark, f"{path}/live", schemas.TOP_WORDS)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``text, size``, largest first; typed and empty if nothing was published."""
    return cloud_items(read_top_words(spark, path)).orderBy(F.desc("size"), F.asc("text"))


def snapshot_json(items: DataFrame) -> DataFrame:
    """One row ``json``: the items, at most K, as one array in the served order."""
    ordered = F.array_sort(F.collect_list(
        F.struct((-F.col("size")).alias("order"), "text", "size")))
    served = F.transform(ordered, lambda i: F.struct(
        i["text"].alias("text"), i["size"].alias("size")))
    return items.agg(F.to_json(served).alias("json"))
