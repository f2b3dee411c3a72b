"""Submissions as a table or a stream, and the table of URLs seen before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termtide import schemas
from termtide.sources.tables import read_or_empty


def read_submissions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.SUBMISSIONS).format(fmt).load(path)


def stream_submissions(spark: SparkSession, path: str | None = None, fmt: str = "parquet",
                       **options: str) -> DataFrame:
    """Stream of submissions from files, or from Kafka with one JSON object per message.

    ``options`` go to the source, such as ``maxFilesPerTrigger`` or ``subscribe``. A message
    that is not a submission gives a NULL URL, which the submission rules reject. A first start on
    a topic reads it from the beginning, as the counts cover the whole history.
    """
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**kafka_options(options)).load()
        return parse_messages(raw)
    return spark.readStream.schema(schemas.SUBMISSIONS).format(fmt).options(**options).load(path)


def kafka_options(options: dict[str, str]) -> dict[str, str]:
    return {"startingOffsets": "earliest", **options}


def parse_messages(raw: DataFrame) -> DataFrame:
    """Submissions from a binary or string ``value`` column holding JSON."""
    message = F.from_json(F.col("value").cast("string"), schemas.SUBMISSIONS)
    return raw.select(message.alias("message")).select("message.*")


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    """URLs accepted before; empty if none was recorded yet."""
    return read_or_empty(spark, path, schemas.SEEN)


def record_seen(accepted: DataFrame, path: str) -> None:
    """Add accepted URLs to the table. A URL recorded twice, by a retry, does no harm."""
    accepted.select("url").write.mode("append").parquet(path)
