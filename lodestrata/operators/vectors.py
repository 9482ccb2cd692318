"""Vectors: cosine ranking, hashing embeddings, quantisation, caches of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.binding import let


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """0 where a vector is zero."""
    scale = (a_norm if a_norm is not None else norm(a)) * (b_norm if b_norm is not None else norm(b))
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def indexed(points: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v, norm: what a search needs, worked out once."""
    return points.select(F.col(key), doubles(vector).alias("v")).withColumn("norm", norm(F.col("v")))


def cosine_top_k(points: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", floor: float | None = None) -> DataFrame:
    """The k points nearest to one stated vector: key, score."""
    q = F.lit([float(x) for x in query])
    scored = indexed(points, key, vector).select(key, cosine(F.col("v"), q, F.col("norm")).alias("score"))
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    return scored.orderBy(F.desc(F.round("score", 6)), key).limit(k)


def quantised(v: Column, digits: int) -> Column:
    """Components rounded half to even."""
    return F.transform(v, lambda x: F.bround(x, digits))


def hash_embedding(tokens: Column, dimension: int = 64) -> Column:
    """Token counts by the first eight bytes of their sha256 modulo the dimension, at unit length."""
    bucket = lambda t: (F.conv(F.substring(F.sha2(t, 256), 1, 16), 16, 10).cast("decimal(20,0)") % dimension).cast("int")
    counted = lambda buckets: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    scaled = lambda counts: let(norm(counts), lambda length: F.when(length > 0, F.transform(counts, lambda c: c / length)).otherwise(counts))
    return let(F.transform(tokens, bucket), lambda buckets: let(counted(buckets), scaled))


def embedded(chunks: DataFrame, include: Column | None = None, text: str = "text", dimension: int = 64, decimals: int | None = None) -> DataFrame:
    """Chunks with a vector; those that `include` leaves out are never embedded."""
    kept = chunks if include is None else chunks.where(include)
    vector = hash_embedding(T.plain_tokens(F.coalesce(F.col(text), F.lit(""))), dimension)
    return kept.withColumn("vector", vector if decimals is None else quantised(vector, decimals))


def merged_cache(entries: DataFrame) -> DataFrame:
    """file_ord, text_sha, vector -> one row a digest: the last file wins. Vectors of several lengths are an error."""
    sizes = entries.agg(F.countDistinct(F.size("vector")).alias("n")).first()["n"]
    if sizes > 1:
        raise ValueError("the cache holds vectors of different lengths")
    last = Window.partitionBy("text_sha").orderBy(F.desc("file_ord"))
    return entries.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def cached(chunks: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Chunks with their cached vectors, and the chunks that the cache misses."""
    keyed = chunks.withColumn("text_sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return keyed.join(cache.select("text_sha", "vector"), "text_sha"), keyed.join(cache.select("text_sha"), "text_sha", "left_anti")
