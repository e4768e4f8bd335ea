"""Session defaults."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, settings: dict[str, str] | None = None) -> SparkSession:
    """A local session as tests and benchmarks use it.  On a cluster the session
    comes from the caller; operators take all settings from it."""
    cores = os.environ.get("BENCH_CPUS", cores)
    builder = SparkSession.builder.master(f"local[{cores}]").appName("palimpsest")
    for key, value in {
        "spark.sql.shuffle.partitions": partitions,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **(settings or {}),
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
