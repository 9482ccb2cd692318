"""Centroid clustering by weighted deduplication: Lloyd's rounds over distinct quantised vectors.

Components become integers, and equal vectors one row with a multiplicity, before anything is iterated. A round reads the
distinct vectors, assigns each to its nearest centroid, and adds up its components times its multiplicity, as integers,
within the task; the sums of a cluster's component meet in one shuffle of few rows. The centroids are all that the driver
holds. At the end the assignments are joined back to the rows by vector: vectors that many rows share are few, so they are
broadcast, and no key of the shuffled join has more than a small share of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CLUSTERS, ROUNDS, SCALE, DIMENSION, SEED = 16, 3, 64, 64, 1
LARGEST = 1 << 27  # of a quantised component: squared distances of 64 of them fit a long
HOT = 1000  # a vector of more than one in so many rows is broadcast; there are fewer of them
ROWS = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def quantised(df: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the components times scale, rounded down, of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = (F.size(x) == dimension) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale < LARGEST))
    held = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.coalesce(sound, F.lit(False)))
    return held.select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("int")).alias("q"))


def _vectors(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dimension).astype(np.int64)


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, the smaller number of several, and the squared distance; all integers."""
    own, least = np.zeros(len(vectors), np.int32), ((vectors - centres[0]) ** 2).sum(1)
    for number, centre in enumerate(centres[1:], 1):
        distance = ((vectors - centre) ** 2).sum(1)
        closer = distance < least
        own[closer], least[closer] = number, distance[closer]
    return own, least


def _summed(groups: DataFrame, centres: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each centroid that has vectors: how many rows, and the sums of their components."""
    size, dimension = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [0] * size, np.zeros((size, dimension), object)
        for batch in batches:
            if batch.num_rows:
                vectors, n = _vectors(batch["q"], dimension), batch["n"].to_numpy()
                own = nearest(vectors, centres)[0]
                fits = int(np.abs(vectors).max()) * int(n.sum()) < 1 << 62
                for c in np.unique(own):
                    few = own == c
                    counts[c] += int(n[few].sum())
                    weighted = vectors[few] * n[few, None] if fits else vectors[few].astype(object) * n[few, None].astype(object)
                    totals[c] += weighted.sum(0).astype(object)
        rows = [(c, i, counts[c], totals[c, i]) for c in range(size) if counts[c] for i in range(dimension)]
        number, place, n, total = zip(*rows, strict=True) if rows else ((), (), (), ())
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38))
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip((number, place, n, total), kinds, strict=True)], names=["cluster", "place", "n", "total"])

    parts = groups.mapInArrow(run, "cluster int, place int, n long, total decimal(38,0)")
    found: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("cluster", "place").collect():  # centroids times components
        found.setdefault(r["cluster"], (r["n"], []))[1].append(int(r["total"]))
    return found


def lloyd(groups: DataFrame, centres: np.ndarray, rounds: int) -> np.ndarray:
    """The centroids after so many rounds over distinct vectors (q) with multiplicities (n)."""
    for _ in range(rounds):
        centres = centres.copy()
        for c, (n, totals) in _summed(groups, centres).items():
            centres[c] = [total // n for total in totals]
    return centres


def cluster(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per vector that takes part: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    df: vec_id and embedding. Vectors that are null, of another length, that hold a null or non-finite number, or one whose
    quantised size is LARGEST or more (a squared distance would not fit a long) take no part. Centroids start as the vectors
    whose '<seed>:<vec_id>' has the smallest sha256, in this order; rows that share a vec_id go by their vectors, and rows
    without one come last. Rows that repeat count as often as they are there; ties go to the smaller centroid; a centroid
    without vectors stays as it is. With fewer vectors than clusters each is a centroid. Inertias beyond a long are null.
    Other columns, whatever they are called, are ignored; an empty table gives no rows."""
    rows = quantised(df, dimension, scale)
    common.bounded(df.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "q").limit(clusters).select("q").collect()
    if not first:
        return df.sparkSession.createDataFrame([], ROWS)
    groups = common.staged(rows.groupBy("q").agg(F.count("*").alias("n")), "vectors")
    centres = lloyd(groups, np.array([r["q"] for r in first], np.int64), rounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own, distance = nearest(_vectors(batch["q"], dimension), centres)
                yield pa.RecordBatch.from_arrays([batch["q"], batch["n"], pa.array(own, pa.int32()), pa.array(distance, pa.int64())], names=["q", "n", "cluster", "distance"])

    assigned = common.staged(groups.mapInArrow(assign, "q array<int>, n long, cluster int, distance long"), "assigned")
    weight = F.col("distance").cast("decimal(20,0)") * F.col("n").cast("decimal(18,0)")
    sums = {r["cluster"]: r for r in assigned.groupBy("cluster").agg(F.sum(weight).alias("inertia"), F.sum("n").alias("n"), F.max("n").alias("most")).collect()}
    inertias = [int(sums[c]["inertia"]) if c in sums else 0 for c in range(len(centres))]
    least = sum(r["n"] for r in sums.values()) // HOT + 1
    found = rows.join(assigned.where(F.col("n") < least).drop("n"), "q")
    if max(r["most"] for r in sums.values()) >= least:
        found = found.unionByName(rows.join(F.broadcast(assigned.where(F.col("n") >= least).drop("n")), "q"))
    of = lambda values, kind: F.get(F.array(*(F.lit(v).cast(kind) for v in values)), "cluster")
    held = lambda x: x if x < 1 << 63 else None
    return found.select(
        "vec_id",
        "cluster",
        "distance",
        of([held(x) for x in inertias], "long").alias("cluster_inertia"),
        F.lit(held(sum(inertias))).cast("long").alias("inertia"),
        of([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()], "string").alias("centroid_sha256"),
    )
