"""Crawled pages, and their descriptions as a table laid out for the lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termtide import params, schemas, workspace
from termtide.operators.descriptions import newest_descriptions


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def save_descriptions(pages: DataFrame, table: str, buckets: int, *,
                      container: str = params.CONTAINER, path: str | None = None) -> DataFrame:
    """Extract descriptions once, one per URL, into a table bucketed by ``url`` and return it.

    A stream with as many state partitions as ``buckets`` joins it without a shuffle. The files
    go to ``path``, by default a new folder in the shared one.
    """
    spark = pages.sparkSession
    path = path or workspace.fresh_dir(spark, "descriptions")
    (newest_descriptions(pages, container)
     .repartition(buckets, "url")
     .write.mode("overwrite").bucketBy(buckets, "url").sortBy("url")
     .option("path", path).saveAsTable(table))
    return spark.table(table)
