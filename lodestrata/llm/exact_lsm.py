"""Exact deduplication with a log-structured merge index of digests.

Every task fills a memtable (digest -> smallest identifier, copies) and flushes it as a run sorted by digest with
a Bloom filter; a task's runs are compacted when there are `fanout` of them. Runs of all tasks then meet by digest and
are compacted into one level, which again keeps the smallest identifier. Rows ask the level by digest and run, so that a
digest that very many rows hold is dealt over the runs. An identifier is the document id
(keep="smallest") or its negation (keep="largest"). Each hit is verified by bytes: inside a memtable at once, between
runs by grouping the texts of the runs' representatives. Two texts with one digest stop the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MEMTABLE_BYTES = 8 << 20
FANOUT = 8


class Bloom:
    """Ten bits a digest, three probes taken from the digest itself."""

    def __init__(self, digests: list[bytes]):
        self.bits = 1 << max(6, (10 * len(digests)).bit_length())
        self.held = np.zeros(self.bits, bool)
        if digests:
            words = np.frombuffer(b"".join(digests), "<u8").reshape(len(digests), -1)
            for probe in range(3):
                self.held[words[:, probe] & np.uint64(self.bits - 1)] = True

    def may_hold(self, digest: bytes) -> bool:
        words = np.frombuffer(digest, "<u8")
        return all(self.held[int(words[probe]) & (self.bits - 1)] for probe in range(3))


class MergeIndex:
    """One task's index. Rows leave as (doc_id, digest, ident, copies, head): ident is the smallest identifier of the digest
    in its run, copies their number there, and head marks one row that holds ident."""

    def __init__(self, memtable_bytes: int = MEMTABLE_BYTES, fanout: int = FANOUT):
        self.memtable_bytes, self.fanout = memtable_bytes, fanout
        self.memtable: dict[bytes, list] = {}
        self.size = 0
        self.runs: list[tuple[Bloom, dict[bytes, list]]] = []

    def add(self, digest: bytes, ident: int, doc_id: int, text: bytes) -> None:
        entry = self.memtable.get(digest)
        if entry is None:
            self.memtable[digest] = [ident, [(ident, doc_id)], text]
            self.size += len(text) + 200
        else:
            if entry[2] != text:
                raise ValueError(f"two texts share the digest {digest.hex()}")
            entry[0] = min(entry[0], ident)
            entry[1].append((ident, doc_id))
            self.size += 80
        if self.size >= self.memtable_bytes:
            self.flush()

    def flush(self) -> None:
        if self.memtable:
            run = {d: self.memtable[d] for d in sorted(self.memtable)}
            self.runs.append((Bloom(list(run)), run))
            self.memtable, self.size = {}, 0

    def drain(self) -> Iterator[tuple[int, bytes, int, int, bool]]:
        """Compacts the runs and empties the index."""
        self.flush()
        runs, self.runs = self.runs, []
        for place, (_, run) in enumerate(runs):
            later = runs[place + 1 :]
            for digest, entry in run.items():
                if entry is None:
                    continue
                for bloom, other in later:
                    if bloom.may_hold(digest) and other.get(digest):
                        hit, other[digest] = other[digest], None
                        if hit[2] != entry[2]:
                            raise ValueError(f"two texts share the digest {digest.hex()}")
                        entry[0] = min(entry[0], hit[0])
                        entry[1] += hit[1]
                first = True
                for ident, doc_id in entry[1]:
                    holds = first and ident == entry[0]
                    first = first and not holds
                    yield doc_id, digest, entry[0], len(entry[1]), holds


ROW = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("ident", pa.int64()), ("copies", pa.int64()), ("head", pa.bool_()), ("run", pa.int64())])


def _runs(sign: int, memtable_bytes: int, fanout: int):
    def flush(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, level = MergeIndex(memtable_bytes, fanout), 0
        task = TaskContext.get()
        part = task.partitionId() if task else 0

        def out():
            rows = list(index.drain())
            if rows:
                columns = [*zip(*rows, strict=True), [part << 24 | level] * len(rows)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ROW.types, strict=True)], schema=ROW)

        for batch in batches:
            for doc_id, digest, text in zip(batch["doc_id"].to_pylist(), batch["digest"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                index.add(digest, sign * doc_id, doc_id, text)
            if len(index.runs) >= fanout:
                yield from out()
                level += 1
        yield from out()

    return flush


LEVEL = pa.schema([("digest", pa.binary()), ("ident", pa.int64()), ("copies", pa.int64()), ("runs", pa.int64())])


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges runs that arrive sorted by digest; a digest may go on in the next batch."""
    held: list | None = None
    for batch in batches:
        out: list[list] = []
        for digest, ident, copies in zip(batch["digest"].to_pylist(), batch["ident"].to_pylist(), batch["copies"].to_pylist(), strict=True):
            if held is not None and held[0] == digest:
                held[1] = min(held[1], ident)
                held[2] += copies
                held[3] += 1
            else:
                if held is not None:
                    out.append(held)
                held = [digest, ident, copies, 1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), LEVEL.types, strict=True)], schema=LEVEL)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(held, LEVEL.types, strict=True)], schema=LEVEL)


def exact_dedup(df: DataFrame, keep: str = "smallest", memtable_bytes: int = MEMTABLE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, however long they are; null counts as empty, and all empty texts form one group.
    Columns besides doc_id and text are ignored. Rows that repeat a doc_id stay as many rows, whether their texts are equal
    or not; of rows with the kept id all count as kept. An empty table gives no rows. A row without a doc_id is compared
    with nothing: it stays, as a group of its own, and its keep_id is null.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    sign = 1 if keep == "smallest" else -1
    rows = common.documents(df)
    docs, bare = rows.where("doc_id is not null"), rows.where("doc_id is null")
    digested = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), "text")
    runs = common.staged(digested.mapInArrow(_runs(sign, memtable_bytes, fanout), "doc_id long, digest binary, ident long, copies long, head boolean, run long"), "lsm-runs")
    heads = runs.where("head")
    level = heads.select("digest", "ident", "copies").repartition("digest").sortWithinPartitions("digest").mapInArrow(_compact, "digest binary, ident long, copies long, runs long")
    hits = heads.select("doc_id", "digest", "run").join(level.where("runs > 1").select("digest", F.col("ident").alias("least"), F.col("copies").alias("all")), "digest")
    hits = common.staged(hits, "lsm-hits")

    own = F.unhex(F.sha2("text", 256)) == F.col("digest")  # another text may have the same doc_id
    texts = docs.join(hits.select("doc_id", "digest").distinct().hint("merge"), "doc_id").where(own).groupBy("digest", "text").agg(F.lit(1).alias("one"))
    clashes = texts.groupBy("digest").count().where("count > 1").limit(1).collect()
    if clashes:
        raise ValueError(f"two texts share the digest {bytes(clashes[0][0]).hex()}")

    found = runs.join(hits.drop("doc_id"), ["digest", "run"], "left")
    keep_id, size = F.coalesce("least", "ident") * sign, F.coalesce("all", "copies")
    found = found.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), (F.col("doc_id") == keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
    return found.unionByName(bare.select("doc_id", F.lit(None).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2("text", 256).alias("text_sha256")))
