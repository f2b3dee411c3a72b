"""Size checks that decide between plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

MIB = 1024 * 1024


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate for ``df`` without running it; None without a local plan to ask."""
    if not hasattr(df, "_jdf"):
        return None
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(df: DataFrame, limit: int) -> bool:
    size = plan_bytes(df)
    return size is not None and size <= limit


def spread(df: DataFrame, *keys: str, limit: int = 256 * MIB) -> DataFrame:
    """Repartition a small input over the cores, leave a large one alone.

    A small Parquet file may hold a single row group, which is one scan task whatever
    the split size. Beyond ``limit`` the scan has splits enough and the shuffle would cost
    more than it gains.
    """
    if df.isStreaming or not fits(df, limit):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if cores > 1 else df
