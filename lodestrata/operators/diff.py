"""Comparing two states of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, status: added, removed, changed or identical, by a null-safe comparison of the values."""
    a = old.select(*key, F.col(value).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*key, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    status = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "identical").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))


def multiset_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows, as often as they are in surplus, with the side that has them."""
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))


def answer_diff(old: DataFrame, new: DataFrame, key: str = "query_id") -> DataFrame:
    """key, status of answers (key, answer): identical, changed, lost or new; a null answer is a miss."""
    joined = old.select(key, F.col("answer").alias("a")).join(new.select(key, F.col("answer").alias("b")), key, "full_outer")
    return joined.select(key, F.when(F.col("a").eqNullSafe(F.col("b")), "identical").when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "new").otherwise("changed").alias("status"))
