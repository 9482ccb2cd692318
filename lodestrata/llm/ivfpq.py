"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Coarse centroids and codebooks are fitted on a bounded sample of unit vectors; every row is then indexed under its
centroid with the codes of its residual. A query scans the lists of its nearest centroids, and more of them until they
hold k candidates: a table of inner products with
all codewords gives each code's approximate cosine (asymmetric: the query itself is not quantised). It is off by the length
of the row's quantisation error at most, so every row that may be among a block's k best by that bound is reranked by the
exact cosine of the original vectors: the quantiser loses nothing. How many lists are scanned is calibrated against brute
force within the sample. Vectors are scaled by a power of two, which changes no cosine and keeps squares finite. Lists are cut into blocks of rows and of queries, so that a list of very many rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE = 20_000
LIST_ROWS = 400
MOST_LISTS = 1024
CODEWORDS = 256
SUBSPACE = 4
RECALL = 0.98
RERANK_ROWS = 4_096  # rows that are reranked at a time
SLACK = 1e-9  # what rounding may change
BLOCK_ROWS, BLOCK_QUERIES = 16_384, 2_048


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[n > 0] = total[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return centres


@dataclass
class Index:
    """What every task needs: at most MOST_LISTS centroids and CODEWORDS codewords a subspace."""

    dimension: int
    centres: np.ndarray
    books: np.ndarray  # subspaces, codewords, SUBSPACE
    probes: int

    def padded(self, x: np.ndarray) -> np.ndarray:
        spare = self.books.shape[0] * SUBSPACE - x.shape[1]
        return np.pad(x, ((0, 0), (0, spare))) if spare else x

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = _nearest(unit, self.centres)
        rest = self.padded(unit - self.centres[own])
        return own, np.stack([_nearest(rest[:, SUBSPACE * s : SUBSPACE * (s + 1)], book) for s, book in enumerate(self.books)], 1).astype(np.uint8)

    def errors(self, unit: np.ndarray, codes: np.ndarray, centre: int) -> np.ndarray:
        """Lengths of what the codes of one list's rows leave out; no approximate cosine is off by more."""
        rest = self.padded(unit - self.centres[centre])
        return np.sqrt(sum(((rest[:, SUBSPACE * s : SUBSPACE * (s + 1)] - book[codes[:, s]]) ** 2).sum(1) for s, book in enumerate(self.books)))

    def lists_of(self, unit: np.ndarray, sizes: np.ndarray, enough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and the lists that each scans: the nearest `probes`, and more until they hold `enough` rows."""
        order = np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        query, place = np.nonzero((np.arange(order.shape[1])[None, :] < self.probes) | (before < enough[:, None]))
        return query, order[query, place]

    def approximate(self, unit: np.ndarray, codes: np.ndarray, centre: int) -> np.ndarray:
        """Cosines of queries (rows) with coded vectors of one list (columns)."""
        tables = np.einsum("qsd,scd->qsc", self.padded(unit).reshape(len(unit), -1, SUBSPACE), self.books)
        scores = np.repeat((unit @ self.centres[centre])[:, None], len(codes), 1)
        for s in range(codes.shape[1]):
            scores += tables[:, s, codes[:, s]]
        return scores


def fit(x: np.ndarray, rows: int, k: int, recall: float = RECALL, seed: int = 11) -> Index:
    """x: a sample's unit vectors; rows: how many rows will be indexed."""
    rng, d = np.random.default_rng(seed), x.shape[1]
    centres = _k_means(x, int(min(MOST_LISTS, max(1, rows // LIST_ROWS))), rng)
    spaces = -(-d // SUBSPACE)
    rest = np.pad(x - centres[_nearest(x, centres)], ((0, 0), (0, spaces * SUBSPACE - d)))
    books = np.zeros((spaces, CODEWORDS, SUBSPACE))
    for s in range(spaces):
        found = _k_means(rest[:, SUBSPACE * s : SUBSPACE * (s + 1)], CODEWORDS, rng, 6)
        books[s] = found[np.arange(CODEWORDS) % len(found)]
    queries = rng.choice(len(x), min(300, len(x)), replace=False)
    near = x[queries] @ x.T
    near[np.arange(len(queries)), queries] = -2
    own, order = _nearest(x, centres), np.argsort(-(x[queries] @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], 1)
    best = np.argsort(-near, axis=1)[:, : max(1, min(k, len(x) - 1))]
    places = np.sort(np.take_along_axis(place, own[best], 1).ravel())
    return Index(d, centres, books, int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def search(df: DataFrame, every: int = 50, k: int = 5, recall: float = RECALL) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vec_id divisible by `every` its k nearest of all other rows.

    df: vec_id and embedding. Vectors that are null, zero, of another length than most, or that hold a null or non-finite
    number take no part, nor do rows without a vec_id; rows that share a query's vec_id are not its neighbours, and of
    several such query vectors the smallest is asked. score is the cosine in double precision; ties go to the smaller
    vec_id. Other columns are ignored. An empty table gives no rows; with fewer than k candidates all of them are found."""
    spark = df.sparkSession
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    held = df.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = held.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not lengths:
        return empty
    size, rows = lengths[0]["size"], lengths[0]["count"]
    held = held.where(F.size("embedding") == size)
    drawn = held.withColumn("place", F.pmod(F.xxhash64("vec_id", "embedding", F.monotonically_increasing_id()), F.lit(1 << 30)))  # rows that repeat are drawn apart
    few = drawn.where(F.col("place") < F.lit(min(1 << 30, int((1 << 30) * 1.2 * SAMPLE / rows))))  # so that few rows go to the task of the limit
    sample = few.orderBy("place", "vec_id").limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()
    if not len(sample):
        sample = held.limit(SAMPLE).select("embedding").toArrow()["embedding"].combine_chunks()

    def scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Vectors whose largest component is near one, and at unit length."""
        vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])
        return vectors, vectors / np.linalg.norm(vectors, axis=1, keepdims=True)

    index = fit(scaled(sample)[1], rows, k, recall)
    blob = lambda matrix: pa.array([row.tobytes() for row in np.ascontiguousarray(matrix)], pa.binary())

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors, unit = scaled(batch["embedding"])
                own, codes = index.encode(unit)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), batch["vec_id"], blob(codes), blob(vectors)], names=["list", "vec_id", "codes", "vector"])

    base = common.staged(held.mapInArrow(coded, "list int, vec_id long, codes binary, vector binary"), "lists")
    counts = {r[0]: r[1] for r in base.groupBy("list").count().collect()}  # at most MOST_LISTS rows, as below
    sizes = np.array([counts.get(i, 0) for i in range(len(index.centres))])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                vectors, unit = scaled(part["embedding"])
                row, lists = index.lists_of(unit, sizes, part["own"].to_numpy() + k)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), part["vec_id"].take(pa.array(row)), blob(vectors[row])], names=["list", "query_id", "query"])

    queries = held.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.count("*").alias("own"))
    asked = queries.mapInArrow(probing, "list int, query_id long, query binary")
    blocks = {i: -(-n // BLOCK_ROWS) for i, n in counts.items()}
    shifts = {r[0]: -(-r[1] // BLOCK_QUERIES) for r in asked.groupBy("list").count().collect()}
    of = lambda numbers: F.coalesce(F.get(F.array(*[F.lit(int(numbers.get(i, 1))) for i in range(len(index.centres))]), "list"), F.lit(1))
    base = base.withColumn("block", F.pmod(F.xxhash64("vec_id"), of(blocks)).cast("int")).withColumn("shift", F.explode(F.sequence(F.lit(0), of(shifts) - 1)))
    asked = asked.withColumn("shift", F.pmod(F.xxhash64("query_id"), of(shifts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), of(blocks) - 1)))

    def scan(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows = rows.sort_values("vec_id")
            ids, vectors = rows["vec_id"].to_numpy(), _matrix(rows["vector"])
            codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
            norms, centre = np.sqrt((vectors * vectors).sum(1)), int(rows["list"].iloc[0])
            off = index.errors(vectors / norms[:, None], codes, centre) + SLACK
            for at in range(0, len(queries), 64):
                part = queries.iloc[at : at + 64]
                asked_ids, own = part["query_id"].to_numpy(), _matrix(part["query"])
                scale = np.sqrt((own * own).sum(1))
                scores = index.approximate(own / scale[:, None], codes, centre)
                scores[asked_ids[:, None] == ids[None, :]] = -np.inf
                for q, row in enumerate(scores):
                    best = np.flatnonzero(row > -np.inf)
                    if len(best) > k:
                        best = best[(row + off)[best] >= np.partition((row - off)[best], -k)[-k]]
                    if len(best) > k:
                        near = np.concatenate([vectors[best[a : a + RERANK_ROWS]] @ own[q] for a in range(0, len(best), RERANK_ROWS)]) / (norms[best] * scale[q])
                        best = best[near >= np.partition(near, -k)[-k] - SLACK]
                    exact = (vectors[best] * own[q]).sum(1) / (norms[best] * scale[q])
                    order = np.lexsort((ids[best], -exact))[:k]
                    out.append((np.full(len(order), asked_ids[q]), ids[best][order], exact[order]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    keys = ["list", "block", "shift"]
    found = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(scan, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
