"""Checks of authored sidecars: every problem is a row, and all are reported together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T

MOST_EXAMPLES = 6


def _problems(rows: DataFrame, key: list[str], checks: dict) -> DataFrame:
    found = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(said)) for said, bad in checks.items())), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(found).alias("problem"))


def example_problems(examples: DataFrame) -> DataFrame:
    """pilot, title, problem of authored examples (pilot, title, description, code, code_sha256)."""
    checks = {"blank title": F.trim("title") == "", "blank code": F.trim("code") == "", "the digest is not the code's": F.lower("code_sha256") != T.code_hash("code"), "a placeholder in the code": F.regexp_like("code", F.lit(r"(?m)^\s*(?:\.\.\.|// \.\.\.|# \.\.\.)\s*$"))}
    many = examples.groupBy("pilot").agg(F.count("*").alias("n")).where(F.col("n") > MOST_EXAMPLES).select("pilot", F.lit(None).cast("string").alias("title"), F.lit("more than six examples").alias("problem"))
    twice = examples.groupBy("pilot", "title").agg(F.count("*").alias("n")).where("n > 1").select("pilot", "title", F.lit("a title twice").alias("problem"))
    return _problems(examples, ["pilot", "title"], checks).unionByName(many).unionByName(twice)


def defect_problems(defects: DataFrame) -> DataFrame:
    """defect_id, problem of known defects (defect_id, kind, refs, summary, status, verified_on)."""
    checks = {
        "blank id": F.trim("defect_id") == "", "blank summary": F.trim("summary") == "", "an unknown kind": ~F.col("kind").isin("method", "class", "package"),
        "no references": F.size("refs") < 1, "an unknown status": ~F.col("status").isin("open", "fixed"), "no date of verification": F.try_to_timestamp("verified_on", F.lit("yyyy-MM-dd")).isNull(),
    }
    twice = defects.groupBy("defect_id").agg(F.count("*").alias("n")).where("n > 1").select("defect_id", F.lit("an id twice").alias("problem"))
    return _problems(defects, ["defect_id"], checks).unionByName(twice)


def merged_candidates(own: DataFrame, authored: DataFrame) -> DataFrame:
    """Candidates (title, code), then authored ones whose title is not among them."""
    known = own.select(F.lower(F.trim("title")).alias("k"))
    fresh = authored.withColumn("k", F.lower(F.trim("title"))).join(known, "k", "left_anti")
    return own.select("title", "code", F.lit("readme").alias("origin")).unionByName(fresh.select("title", "code", F.lit("authored").alias("origin")))


def merged_verdicts(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ("provenance", "code_sha256", "library_commit", "platform", "toolchain")) -> DataFrame:
    """The verification cache with new entries over old ones of the same five fields."""
    fresh = old.join(new.select(*key), list(key), "left_anti")
    return fresh.unionByName(new, allowMissingColumns=True)
