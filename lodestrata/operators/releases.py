"""Releases, tags and sections: merging lists that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import versions


def trimmed(tag: Column | str) -> Column:
    """A tag's version without zeros at its end: 26.9 and 26.9.0 are one."""
    v = versions.parsed(tag)
    last = F.array_max(F.transform(v, lambda x, i: F.when(x != 0, i + 1).otherwise(1)))
    return F.slice(v, F.lit(1), last)


def newest_first(tags: DataFrame, tag: str = "tag_name", order: str = "ord") -> DataFrame:
    return tags.orderBy(F.desc_nulls_last(versions.parsed(tag)), order)


def merge_newer_tags(releases: DataFrame, tags: DataFrame, tag: str = "tag_name") -> DataFrame:
    """tag, source, ord: tags whose version is above that of every release, newest first, then the releases as they were. Without
    a release that has a version nothing is added."""
    newest = F.broadcast(releases.agg(F.max(trimmed(tag)).alias("newest")))  # one row
    fresh = tags.withColumn("v", trimmed(tag)).crossJoin(newest).where(F.col("v") > F.col("newest"))
    one = fresh.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("ord"))).where("n = 1")
    ahead = one.select(tag, F.lit("tag").alias("source"), (F.row_number().over(Window.orderBy(F.desc("v"))) - 1_000_000).alias("ord"))
    return ahead.unionByName(releases.select(tag, F.lit("release").alias("source"), F.col("ord").cast("int").alias("ord")))


def pad_with_older_tags(releases: DataFrame, tags: DataFrame, limit: int, tag: str = "tag_name") -> DataFrame:
    """All releases, then tags of versions that are not among them, one a version, newest first, as many as the limit leaves room
    for. The limit cuts no release."""
    known = releases.select(trimmed(tag).alias("v")).where("v is not null")
    older = tags.withColumn("v", trimmed(tag)).where("v is not null").join(known, "v", "left_anti")
    newest = older.groupBy("v").agg(F.min_by(tag, "ord").alias(tag)).orderBy(F.desc("v")).limit(limit)  # so few rows are numbered in one task
    room = F.broadcast(releases.agg((F.lit(limit) - F.count("*")).alias("room")))  # one row
    one = newest.select(tag, F.lit("tag").alias("source"), F.lit(1).alias("part"), F.row_number().over(Window.orderBy(F.desc("v"))).alias("ord")).crossJoin(room).where(F.col("ord") <= F.col("room")).drop("room")
    own = releases.select(tag, F.lit("release").alias("source"), F.lit(0).alias("part"), F.col("ord").cast("int").alias("ord"))
    return own.unionByName(one).orderBy("part", "ord").select(tag, "source")


def align(releases: DataFrame, indexed_commit: str, indexed_version: str, tag: str = "tag_name") -> DataFrame:
    """The first release of each tag with how it stands to the index."""
    first = releases.withColumn("n", F.row_number().over(Window.partitionBy(tag).orderBy("ord"))).where("n = 1")
    a = versions.alignment(tag, F.col("target_commitish"), F.lit(indexed_commit), versions.parsed(F.lit(indexed_version)))
    return first.select(tag, a.alias("a")).select(tag, "a.in_index", "a.basis")


def merged_sections(primary: DataFrame, fallback: DataFrame, key: str = "section") -> DataFrame:
    """section, text, origin: the primary text, else the fallback's; an install section made of FAQ only yields to it."""
    p, f = primary.select(key, F.col("text").alias("p"), F.coalesce("faq_only", F.lit(False)).alias("faq")), fallback.select(key, F.col("text").alias("f"))
    yields = (F.col(key) == "install") & F.coalesce("faq", F.lit(False)) & F.col("f").isNotNull()
    joined = p.join(f, key, "full_outer")
    return joined.select(key, F.when(yields, F.col("f")).otherwise(F.coalesce("p", "f")).alias("text"), F.when(yields | F.col("p").isNull(), "fallback").otherwise("primary").alias("origin"))
