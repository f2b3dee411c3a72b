"""Session for one machine: tests, checks and the benchmark.

On a cluster the session comes from ``spark-submit``; the package sets nothing there.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str, cores: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
