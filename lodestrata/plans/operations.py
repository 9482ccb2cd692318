"""What a running deployment checks: whether its generation can be served, whether the pointer still stands, whether staged
files must be fetched again."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import grammar, predicates

from .publish import Scope, Store
from .shared_files import Folder

SYMBOL_FLOOR, DOCUMENTATION_FLOOR = 3, 1
FRESH_SECONDS = 24 * 3600.0


def readiness(chunks: DataFrame, by: list[str], symbol_floor: int = SYMBOL_FLOOR, documentation_floor: int = DOCUMENTATION_FLOOR) -> DataFrame:
    """by, ready, reasons, warnings, symbols, docs, examples of the chunks (chunk_id, text) of each group: reasons keep a
    generation from being served, warnings do not. Where chunks are malformed nothing else is said of them."""
    bad = F.coalesce("chunk_id", F.lit("")).eqNullSafe(F.lit("")) | F.col("text").isNull()
    kind = predicates.chunk_kind("text")
    commit = F.explode_outer(F.array_distinct(grammar.headers(F.coalesce("text", F.lit("")), "Source-Commit")))
    rows = chunks.withColumn("_bad", bad).withColumn("_kind", kind)
    n = lambda name: F.sum((~F.col("_bad") & (F.col("_kind") == name)).cast("long"))
    counts = rows.groupBy(*by).agg(n("symbol").alias("symbols"), n("documentation").alias("docs"), n("example").alias("examples"), F.sum(F.col("_bad").cast("long")).alias("bad"))
    commits = rows.where(~F.col("_bad")).select(*by, commit.alias("commit")).groupBy(*by).agg(F.countDistinct("commit").alias("commits"))
    sound = F.col("bad") == 0
    below = lambda column, name, floor: F.when(sound & (F.col(column) < floor), F.concat(F.lit(f"{name} "), F.col(column).cast("string"), F.lit(f" below the floor {floor}")))
    malformed = F.when(~sound, F.concat(F.col("bad").cast("string"), F.lit(" documents are malformed (chunk_id, text)")))
    reasons = F.array_compact(F.array(malformed, below("symbols", "symbols", symbol_floor), below("docs", "documentation", documentation_floor)))
    mixed = F.when(sound & (F.col("commits") > 1), F.concat(F.lit("generation mixes "), F.col("commits").cast("string"), F.lit(" source commits")))
    warnings = F.array_compact(F.array(F.when(sound & (F.col("examples") == 0), "no verified examples"), mixed))
    joined = counts.join(commits, by, "left").withColumn("commits", F.coalesce("commits", F.lit(0)))
    return joined.select(*by, (F.size(reasons) == 0).alias("ready"), reasons.alias("reasons"), warnings.alias("warnings"), "symbols", "docs", "examples")


@dataclass
class GenerationWatch:
    """Remembers the generation that it last saw, so that a pointer which goes is told from one that never was."""

    store: Store
    scope: Scope
    seen: str | None = field(default=None)

    def problem(self) -> str | None:
        """Why the tools cannot answer, or null; a deployment that has never published is no problem."""
        try:
            active = self.store.active(self.scope)
        except Exception as error:
            return f"active pointer is unreadable ({type(error).__name__})"
        if active is None:
            return "active pointer has vanished" if self.seen else None
        try:
            empty = self.store.read(self.scope, active).isEmpty()
        except Exception as error:
            return f"generation file is unreadable ({type(error).__name__})"
        if empty:
            return "generation has no lexical documents"
        self.seen = active
        return None


def rate_limited(events: DataFrame, by: str, interval: float = 10.0, burst: int = 5) -> DataFrame:
    """The events (by, at in seconds, message) that a log lets through, with how many it held back before each window's first:
    a window opens with the first event after the one before it has passed, and holds `burst` events.

    Windows follow from one another, so a key's events are walked in order, as a stream of batches: what is kept of a key is a
    window's start and two counts, however many events it has. Events without a time are left out."""
    columns = [by, "at", "message"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start, sent, held = False, None, 0, 0
        key = None
        for batch in batches:
            out: list[tuple] = []
            for own, at, message in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if not known or own != key:
                    known, key, start, sent, held = True, own, None, 0, 0
                before = 0
                if start is None or at - start >= interval:
                    start, sent, held, before = at, 0, 0, held
                if sent < burst:
                    sent += 1
                    out.append((own, at, message, before))
                else:
                    held += 1
            if out:
                kinds = [batch.schema.field(c).type for c in columns] + [pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=[*columns, "suppressed"])

    ordered = events.select(by, F.col("at").cast("double").alias("at"), "message").where("at IS NOT NULL").repartition(by).sortWithinPartitions(*columns)
    return ordered.mapInArrow(walk, f"{by} {events.schema[by].dataType.simpleString()}, at double, message string, suppressed int")


class Sidecar:
    """A staged JSON list with what is known of its last fetch: good data is never replaced by a failure."""

    def __init__(self, folder: Folder, name: str, repository: str):
        self.folder, self.name, self.repository = folder, name, repository

    def _list(self) -> list | None:
        try:
            held = json.loads(self.folder.read(self.name, most=64 << 20) or "null")
        except ValueError:
            return None
        return held if isinstance(held, list) else None

    def _meta(self) -> dict:
        try:
            held = json.loads(self.folder.read(f"{self.name}.meta") or "{}")
        except ValueError:
            return {}
        return held if isinstance(held, dict) else {}

    def fresh(self, seconds: float = FRESH_SECONDS, now: float | None = None) -> bool:
        """Whether the list need not be fetched: it is a good one, no fetch has failed since, and it is not old."""
        if self.folder.exists(f"{self.name}.failed") or self._list() is None:
            return False
        return (time.time() if now is None else now) - self._meta().get("at", 0) < seconds

    def etag(self) -> str | None:
        """The tag to send along: of a good list that was fetched from this repository."""
        meta = self._meta()
        known = self._list() is not None and meta.get("state") == "ok" and meta.get("repository") == self.repository
        return meta.get("etag") or None if known else None

    def fetched(self, rows: list | None, etag: str | None, now: float | None = None) -> str:
        """What a fetch brought: rows, or none where nothing has changed."""
        if rows is not None:
            self.folder.swap(self.name, json.dumps(rows))
        meta = {"state": "ok", "repository": self.repository, "etag": etag, "at": time.time() if now is None else now}
        self.folder.swap(f"{self.name}.meta", json.dumps(meta, sort_keys=True))
        if self.folder.exists(f"{self.name}.failed"):
            self.folder.delete(f"{self.name}.failed")
        return "unchanged" if rows is None else "replaced"

    def failed(self, reason: str) -> str:
        """A fetch that brought nothing: what is there stays; an empty list where nothing is."""
        self.folder.swap(f"{self.name}.failed", reason)
        if self._list() is not None:
            return "kept"
        self.folder.swap(self.name, "[]")
        self.folder.swap(f"{self.name}.meta", json.dumps({"state": "fetch_failed", "repository": self.repository, "etag": None, "at": 0}, sort_keys=True))
        return "empty"
