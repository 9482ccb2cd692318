"""Session settings the library is tested with."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "lodestrata", cores: str = "*") -> SparkSession:
    """A local session: UTC, adaptive execution, shuffle partitions matched to the machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LODESTRATA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
