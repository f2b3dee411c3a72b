"""Descriptions of pages, and the lookup of submitted pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termtide import params, workspace
from termtide.functions.html import first_paragraph


def descriptions(pages: DataFrame, container: str = params.CONTAINER) -> DataFrame:
    """Replace ``html`` by ``description``; a page without one gives no row."""
    return first_paragraph(pages, container)


def newest_descriptions(pages: DataFrame, container: str = params.CONTAINER) -> DataFrame:
    """``url, description``: one row per URL, of its newest page (largest ``page_id``) that has a
    description. Only descriptions are shuffled, not HTML."""
    found = descriptions(pages.select("page_id", "url", "html"), container)
    return found.groupBy("url").agg(F.max_by("description", "page_id").alias("description"))


def submitted_descriptions(accepted: DataFrame, pages: DataFrame, *,
                           container: str = params.CONTAINER,
                           broadcast_rows: int = 1_000_000) -> DataFrame:
    """``url, description`` of the accepted URLs that have a page with a description, one row each.

    HTML is never shuffled. In batch the pages of the accepted URLs are looked up on the narrow
    columns first. That list is written, so its size is known: up to ``broadcast_rows`` it
    filters the pages before extraction, beyond that descriptions are extracted first and joined.
    """
    urls = accepted.select("url")
    if accepted.isStreaming:
        return urls.join(newest_descriptions(pages, container), "url")
    spark = accepted.sparkSession
    path = workspace.fresh_dir(spark, "wanted")
    pages.select("page_id", "url").join(urls.distinct(), "url").select("page_id").write.parquet(path)
    wanted = spark.read.schema("page_id LONG").parquet(path)
    if wanted.count() <= broadcast_rows:
        return newest_descriptions(pages.join(F.broadcast(wanted), "page_id"), container)
    found = descriptions(pages.select("page_id", "url", "html"), container).join(wanted, "page_id")
    return found.groupBy("url").agg(F.max_by("description", "page_id").alias("description"))
