"""Session factory and the few runtime settings every plan relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "wayfold", cpus: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own to every function."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
