"""Session helper: fixed time zone, adaptive execution, no machine-local settings on a cluster."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "lakeloom", cores: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass the cluster's own session instead."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LAKELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
