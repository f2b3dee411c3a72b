"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

SUBMISSIONS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("url", T.StringType()),
])
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
SEEN = T.StructType([T.StructField("url", T.StringType())])
DESCRIPTIONS = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("description", T.StringType()),
])
WORD_COUNTS = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("n", T.LongType()),
])
TOP_WORDS = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("score", T.DoubleType()),
])
CLOUD_ITEMS = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("size", T.IntegerType()),
])
