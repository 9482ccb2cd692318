"""A cache of embeddings that is written back: texts are embedded once, by their digest, and read from then on.

Misses are an anti-join of the texts' digests, so equal texts are asked for once. Tasks call the provider in batches, each
with a bounded number of attempts, and what they get is appended in one commit: a task or a job that fails leaves nothing
that is read. Entries that two writers append for one digest are one.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.providers import Provider, Transient

ENTRY = "text_sha string, vector array<double>"
BATCH, ATTEMPTS, WAIT_S, WAIT_MORE = 64, 3, 0.5, 2.0
TASK_ROWS = 2_048


class TooManyRequests(ValueError):
    """The misses need more requests than are allowed; none was made."""


def asked(provider: Provider, texts: list[str], attempts: int = ATTEMPTS, wait: float = WAIT_S) -> list[list[float]]:
    """The provider's vectors of one batch. Only transient failures are tried again, each after a longer wait."""
    for attempt in range(1, attempts + 1):
        try:
            vectors = provider.embed(texts)
            break
        except Transient:
            if attempt == attempts:
                raise
            time.sleep(wait)
            wait *= WAIT_MORE
    if len(vectors) != len(texts) or any(len(v) != provider.dimension for v in vectors):
        raise ValueError(f"{len(texts)} texts need as many vectors of {provider.dimension} numbers")
    return [[float(x) for x in v] for v in vectors]


class EmbeddingCache:
    """The entries of one provider in a shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def entries(self) -> DataFrame:
        """text_sha, vector: one row a digest."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(self.folder).groupBy("text_sha").agg(F.min("vector").alias("vector"))

    def misses(self, chunks: DataFrame, text: str = "text") -> DataFrame:
        """text_sha, text: the different texts that are not there; a null text is an empty one."""
        own = F.coalesce(F.col(text), F.lit(""))
        wanted = chunks.select(F.sha2(own, 256).alias("text_sha"), own.alias("text")).groupBy("text_sha").agg(F.min("text").alias("text"))
        return wanted.join(self.entries().select("text_sha"), "text_sha", "left_anti")

    def fill(self, chunks: DataFrame, provider: Provider, text: str = "text", batch: int = BATCH, attempts: int = ATTEMPTS, wait: float = WAIT_S, requests: int | None = None) -> int:
        """Embeds what is missing and appends it; how many texts that were. requests: at most so many, attempts included."""
        misses = self.misses(chunks, text)
        number = misses.count()
        if not number:
            return 0
        tasks = -(-number // TASK_ROWS)
        most = (number // batch + tasks) * attempts  # every task may end with a batch that is not full
        if requests is not None and most > requests:
            raise TooManyRequests(f"{number} texts may take {most} requests; {requests} are allowed")

        def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[tuple[str, str]] = []

            def out(rows: list[tuple[str, str]]) -> pd.DataFrame:
                return pd.DataFrame({"text_sha": [r[0] for r in rows], "vector": asked(provider, [r[1] for r in rows], attempts, wait)})

            for frame in frames:
                held += zip(frame["text_sha"], frame["text"], strict=True)
                while len(held) >= batch:
                    yield out(held[:batch])
                    del held[:batch]
            if held:
                yield out(held)

        dealt = misses.repartitionByRange(tasks, "text_sha") if tasks > 1 else misses.coalesce(1)
        dealt.mapInPandas(embed, ENTRY).write.mode("append").parquet(self.folder)
        return number

    def embedded(self, chunks: DataFrame, provider: Provider, text: str = "text", **how) -> DataFrame:
        """chunks with a column vector, from the cache, which is filled first."""
        self.fill(chunks, provider, text, **how)
        keyed = chunks.withColumn("text_sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        return keyed.join(self.entries(), "text_sha").drop("text_sha")
