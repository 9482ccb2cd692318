"""Immutable generations, the active pointer, and the rules of publishing.

A generation is a folder of Parquet that is written once. The pointer is one small file beside it, swapped by an atomic
rename under a lock, as is the lease, whose fencing token keeps a writer whose lease has passed from swapping. All of them
lie in the shared folder, so that writers may run on any machine. The log has a file for each entry.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import predicates

from .shared_files import Folder

COMPONENT = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]{0,63}")


class Refused(ValueError):
    """A publication that the rules do not let through."""


class Conflict(RuntimeError):
    """The pointer is not what the writer expected, or the writer's lease has passed."""


@dataclass(frozen=True)
class Scope:
    family: str
    platform: str
    source_kind: str

    def __post_init__(self):
        for part in (self.family, self.platform, self.source_kind):
            if not COMPONENT.fullmatch(part) or ".." in part:
                raise ValueError(f"not a scope component: {part!r}")

    def __str__(self) -> str:
        return f"{self.family}::{self.platform}::{self.source_kind}"

    @property
    def folder(self) -> str:
        return f"{self.family}__{self.platform}__{self.source_kind}"


@dataclass(frozen=True)
class Policy:
    least_symbols: int = 3
    least_docs: int = 1
    symbol_drop: float = 0.2
    other_drop: float = 0.5
    history: int = 3


def stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: symbols, docs, examples, total, duplicates of chunk_id, empty texts."""
    kind = predicates.chunk_kind(F.coalesce(F.col(text), F.lit("")))
    of = lambda k: F.coalesce(F.sum((kind == k).cast("long")), F.lit(0))
    return chunks.agg(of("symbol").alias("symbols"), of("documentation").alias("docs"), of("example").alias("examples"), F.count("*").alias("total"), (F.count("*") - F.countDistinct("chunk_id")).alias("duplicates"), F.coalesce(F.sum((F.trim(F.coalesce(F.col(text), F.lit(""))) == "").cast("long")), F.lit(0)).alias("empty"))


def problems(new: dict, baseline: dict | None, policy: Policy = Policy(), accepted: tuple[str, ...] = ()) -> list[str]:
    """Why these counts may not be published; accepted holds `kind:old->new` overrides."""
    out = []
    if new.get("duplicates") or new.get("empty"):
        out.append("duplicate ids or empty texts")
    out += [f"{kind} {new[kind]} is under {least}" for kind, least in (("symbols", policy.least_symbols), ("docs", policy.least_docs)) if new[kind] < least]
    for kind in ("symbols", "docs", "examples") if baseline else ():
        old, now = baseline.get(kind) or 0, new[kind]
        most = policy.symbol_drop if kind == "symbols" else policy.other_drop
        if old and now < old * (1 - most) and f"{kind}:{old}->{now}" not in accepted:
            out.append(f"{kind} fell from {old} to {now}")
    return out


def baseline(log: DataFrame, history: int = 3) -> DataFrame:
    """scope and the largest counts over the newest `history` published rows, up to the first with an override and with it."""
    newest = Window.partitionBy("scope").orderBy(F.desc("ts"), F.desc("generation_id"))
    before = F.coalesce(F.sum(F.col("override").cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = log.where("event = 'published'").withColumn("n", F.row_number().over(newest)).withColumn("before", before)
    return rows.where((F.col("n") <= history) & (F.col("before") == 0)).groupBy("scope").agg(*(F.max(k).alias(k) for k in ("symbols", "docs", "examples")))


def retained(generations: DataFrame, keep: int = 3) -> DataFrame:
    """generations (scope, generation_id, version, active, protected) with a column kept."""
    newest = Window.partitionBy("scope").orderBy(F.desc("version"), F.desc("generation_id"))
    return generations.withColumn("kept", (F.row_number().over(newest) <= keep) | F.col("active") | F.col("protected"))


class Store:
    """Generations below one folder that the driver and the executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, scope: Scope) -> Folder:
        return Folder(self.spark, f"{self.root}/{scope.folder}")

    def lease(self, scope: Scope, seconds: float = 300) -> int:
        """A new fencing token; the one before it is void."""
        folder = self._folder(scope)
        with folder.locked("lock", Conflict("another writer holds the lock")):
            token = json.loads(folder.read("lease.json") or '{"token": 0}')["token"] + 1
            folder.swap("lease.json", json.dumps({"token": token, "until": time.time() + seconds}))
        return token

    def active(self, scope: Scope) -> str | None:
        held = self._folder(scope).read("active.json")
        return json.loads(held)["generation_id"] if held else None

    def write(self, scope: Scope, version: str, chunks: DataFrame) -> str:
        """Writes a generation once; the same content again is nothing new, other content an error. Contents are compared by
        the number of rows and sums over their digests, in whatever order rows come."""
        generation = f"{scope.folder}__{version}"
        folder = self._folder(scope)
        row = F.sha2(F.to_json(F.struct(*sorted(chunks.columns)), {"ignoreNullFields": "false"}), 256)
        part = lambda at: F.sum(F.conv(F.substring("row", at, 15), 16, 10).cast("decimal(38,0)"))
        sums = chunks.select(row.alias("row")).agg(F.count("*"), *(part(1 + 15 * i) for i in range(4))).first()
        digest = hashlib.sha256(repr(tuple(map(str, sums))).encode()).hexdigest()
        held = folder.read(f"{generation}.sha256")
        if held is not None:
            if held != digest:
                raise Conflict(f"{generation} exists with other content")
            return generation
        chunks.write.mode("overwrite").parquet(f"{folder.path}/{generation}")
        folder.swap(f"{generation}.sha256", digest)
        return generation

    def read(self, scope: Scope, generation: str | None = None) -> DataFrame:
        generation = generation or self.active(scope)
        if generation is None:
            raise LookupError("no active generation")
        return self.spark.read.parquet(f"{self._folder(scope).path}/{generation}")

    def generations(self, scope: Scope) -> list[str]:
        return sorted((n.removesuffix(".sha256") for n in self._folder(scope).names() if n.endswith(".sha256")), reverse=True)

    def activate(self, scope: Scope, generation: str, expected: str | None, token: int) -> None:
        """Compare and swap, under a lock file and the current token."""
        folder = self._folder(scope)
        with folder.locked("lock", Conflict("another writer holds the lock")):
            if token != json.loads(folder.read("lease.json") or '{"token": 0}')["token"]:
                raise Conflict("the lease has passed to another writer")
            if self.active(scope) != expected:
                raise Conflict(f"the active generation is {self.active(scope)}, not {expected}")
            if generation not in self.generations(scope):
                raise LookupError(f"no such generation: {generation}")
            folder.swap("active.json", json.dumps({"generation_id": generation}))

    def publish(self, scope: Scope, version: str, chunks: DataFrame, policy: Policy = Policy(), accepted: tuple[str, ...] = ()) -> str:
        """Checks, writes, activates and logs; a refusal is logged too."""
        token, before = self.lease(scope), self.active(scope)
        new = stats(chunks).first().asDict()
        old = stats(self.read(scope, before)).first().asDict() if before else None
        found = problems(new, old, policy, accepted)
        if found:
            self.log(scope, {"event": "refused", "generation_id": None, "stats": new, "reason": "; ".join(found)})
            raise Refused("; ".join(found))
        generation = self.write(scope, version, chunks)
        try:
            self.activate(scope, generation, before, token)
        except Conflict:
            self.discard(scope, generation)
            raise
        self.log(scope, {"event": "published", "generation_id": generation, "previous_active": before, "stats": new, "overrides": list(accepted)})
        return generation

    def rollback(self, scope: Scope, generation: str | None = None) -> str:
        now = self.active(scope)
        older = [g for g in self.generations(scope) if now is None or g < now]
        target = generation or (older[0] if older else None)
        if target is None:
            raise LookupError("nothing to roll back to")
        self.activate(scope, target, now, self.lease(scope))
        self.log(scope, {"event": "rolled_back", "generation_id": target, "previous_active": now})
        return target

    def prune(self, scope: Scope, keep: int = 3) -> list[str]:
        gone = [g for g in self.generations(scope)[keep:] if g != self.active(scope)]
        for generation in gone:
            self.discard(scope, generation)
        return gone

    def discard(self, scope: Scope, generation: str) -> None:
        if generation == self.active(scope):
            raise Conflict("the active generation stays")
        folder = self._folder(scope)
        folder.delete(generation)
        folder.delete(f"{generation}.sha256")

    def log(self, scope: Scope, entry: dict) -> None:
        line = json.dumps({"ts": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "scope": str(scope), **entry}, sort_keys=True)
        Folder(self.spark, f"{self._folder(scope).path}/publish_log").swap(f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.jsonl", line + "\n")
