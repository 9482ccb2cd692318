"""Cuts of lineage in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where that is unset and all tasks run in the driver's
    process."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lodestrata-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, worked out once and kept in the shared folder: it survives lost executors, and nothing above it runs again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
