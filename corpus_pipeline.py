"""The corpus pipeline: each stage works on what the one before it kept, as Parquet.

1. quality classifier: rejected documents go; 2. exact dedup: of equal texts the largest doc_id stays; 3. n-gram Jaccard
join: of each class of near-duplicates the smallest doc_id stays; 4. secret scans: spans are replaced by a mark; 5. best-fit
packing: the sequences. Rows without a doc_id go through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import common, cotrain, exact_lsm, jaccard_forest, packing, queries, secrets


def _stay(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and text_sha256 are in keep, one of those that repeat both; and all without a doc_id,
    which no stage can compare."""
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    own = F.col("doc_id").isNotNull()
    kept = named.where(own).join(keep.select("doc_id", "text_sha256").distinct().hint("merge"), ["doc_id", "text_sha256"], "left_semi").dropDuplicates(["doc_id", "text_sha256"])
    return kept.unionByName(named.where(~own)).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier, fitted on `labels`, keeps; all of them where it cannot be fitted."""
    return cotrain.keep_good(docs, common.table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (null counts as empty) one with the largest doc_id."""
    return _stay(docs, exact_lsm.exact_dedup(docs, keep="largest").where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row with the smallest doc_id; texts without words are no class."""
    return _stay(docs, jaccard_forest.near_duplicates(docs).where("stays"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with a mark in place of every secret; n_chars follows."""
    return secrets.redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed into sequences."""
    return packing.pack_documents(docs, queries._vocabulary_path())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("secret scans", secret), ("best-fit packing", pack)]

#: The classifier and the tokenizer have no SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the table documents; each but the last is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
