"""Measures of answers and of operation: hits, ranks, percentiles, histograms, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def retrieval_quality(answers: DataFrame, family: str, rank: str, k: int = 3) -> DataFrame:
    """family (ALL for all), n, hit_at_k, mrr, wrong_rate; a null rank is no answer, rank 0 a wrong one."""
    hit = F.when((F.col(rank) >= 1) & (F.col(rank) <= k), 1.0).otherwise(0.0)
    found = answers.groupingSets([[family], []], family).agg(F.count("*").alias("n"), F.avg(hit).alias("hit_at_k"), F.avg(F.when(F.col(rank) >= 1, 1 / F.col(rank)).otherwise(0.0)).alias("mrr"), F.avg(F.when(F.col(rank) == 0, 1.0).otherwise(0.0)).alias("wrong_rate"), F.grouping(family).alias("_all"))
    return found.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(family)).alias(family), "n", "hit_at_k", "mrr", "wrong_rate")


def nearest_rank(values: DataFrame, by: list[str], value: str, p: float) -> DataFrame:
    """The smallest value that at least a share p of the values do not exceed."""
    return values.groupBy(*by).agg(F.expr(f"percentile_disc({p}) within group (order by {value})").alias("value"))


def histogram(calls: DataFrame, by: list[str], seconds: Column, edges: tuple[float, ...] = BUCKETS) -> DataFrame:
    """by, le, n (cumulative), total, count; le is null for the last bucket, which holds all."""
    held = calls.groupBy(*by).agg(*(F.count(F.when(seconds <= e, 1)).alias(f"_{i}") for i, e in enumerate(edges)), F.sum(seconds).alias("total"), F.count("*").alias("count"))
    rows = F.array(*(F.struct(F.lit(e).alias("le"), F.col(f"_{i}").alias("n")) for i, e in enumerate(edges)), F.struct(F.lit(None).cast("double").alias("le"), F.col("count").alias("n")))
    return held.select(*by, F.explode(rows).alias("b"), "total", "count").select(*by, "b.le", "b.n", "total", "count")


def exposition(series: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Lines `name{label="value"} number` of a metrics page, sorted."""
    quote = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), quote(c), F.lit('"')) for c in labels))
    return series.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line")).orderBy("line")


def zero_filled(counts: DataFrame, spark, kinds: tuple[str, ...], kind: str = "kind") -> DataFrame:
    """Every kind with its count, zero where there is none."""
    return spark.createDataFrame([(k,) for k in kinds], f"{kind} string").join(counts, kind, "left").select(kind, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ledger(counts: DataFrame, levels: list[str], value: str) -> DataFrame:
    return counts.rollup(*levels).agg(F.sum(value).alias(value))
