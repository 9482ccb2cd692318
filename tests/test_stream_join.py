"""Joins of two streams, and a table that holds each batch once."""

from __future__ import annotations

import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrata.streaming import telemetry

SCHEMA = "k long, ts timestamp_ntz, kind string"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def put(spark, folder: Path, number: int, rows):
    made = spark.createDataFrame([(k, at(m), kind) for k, m, kind in rows], SCHEMA).coalesce(1)
    made.write.parquet(str(folder / f"part{number}"))


def joined(spark, folder, how="inner"):
    side = lambda kind: telemetry.stream(spark, str(folder / "part*"), SCHEMA, files=1).where(F.col("kind") == kind)
    return telemetry.matched(side("q"), side("a"), "k", "30 MINUTES", "10 minutes", how)


def held(rows):
    return sorted((r.k, r.asked_at.minute + 60 * r.asked_at.hour, r.answered_at and r.answered_at.minute + 60 * r.answered_at.hour) for r in rows.collect())


@pytest.fixture()
def folder(spark, tmp_path):
    put(spark, tmp_path, 0, [(1, 0, "q"), (2, 5, "q"), (1, 10, "a"), (None, 1, "q"), (None, 2, "a")])
    put(spark, tmp_path, 1, [(1, 30, "a"), (1, 31, "a"), (2, 4, "a"), (3, 20, "q")])
    put(spark, tmp_path, 2, [(9, 500, "q"), (9, 500, "a")])
    put(spark, tmp_path, 3, [(8, 900, "q"), (8, 901, "a")])
    return tmp_path


def test_a_batch_that_runs_again_changes_nothing(spark, folder):
    table, checkpoint = f"{folder}/table", f"{folder}/checkpoint"
    want = [(1, 0, 10), (1, 0, 30), (8, 900, 901), (9, 500, 500)]
    first = telemetry.exactly_once(joined(spark, folder), table, checkpoint)
    assert held(first) == want
    commits = sorted((Path(checkpoint) / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for found in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        found.unlink(missing_ok=True)  # as if the run had died after the write and before the commit
    assert held(telemetry.exactly_once(joined(spark, folder), table, checkpoint)) == want
    put(spark, folder, 4, [(7, 1000, "q"), (7, 1001, "a")])
    assert held(telemetry.exactly_once(joined(spark, folder), table, checkpoint)) == sorted([*want, (7, 1000, 1001)])


def test_what_is_never_answered_comes_when_its_time_is_over(spark, folder):
    found = held(telemetry.exactly_once(joined(spark, folder, "left_outer"), f"{folder}/t", f"{folder}/c").where("k IS NOT NULL"))
    assert (2, 5, None) in found and (3, 20, None) in found and (1, 0, None) not in found
    table = lambda kind: spark.read.schema(SCHEMA).parquet(str(folder / "part*")).where(F.col("kind") == kind)
    assert held(telemetry.matched(table("q"), table("a"), "k", "30 MINUTES")) == [(1, 0, 10), (1, 0, 30), (8, 900, 901), (9, 500, 500)]
