"""The cache of embeddings: what is asked, what is written, what fails."""

from __future__ import annotations

import os
import uuid

import pytest

from lodestrata.functions.providers import Hashing, Transient
from lodestrata.sources import embedding_cache
from lodestrata.sources.embedding_cache import EmbeddingCache


class Counted(Hashing):
    """Notes every call as a file; fails so many times first."""

    def __init__(self, folder, failures=0, error=Transient, short=False):
        super().__init__(8)
        self.folder, self.failures, self.error, self.short = str(folder), failures, error, short

    def embed(self, texts):
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as file:
            file.write("\n".join(texts))
        if len(os.listdir(self.folder)) <= self.failures:
            raise self.error("not now")
        return super().embed(texts[1:] if self.short else texts)


def calls(folder):
    return [len((folder / name).read_text().split("\n")) for name in os.listdir(folder)]


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame([(i, f"text {i % 10}") for i in range(30)] + [(30, None), (31, "")], "id int, text string")


def test_a_second_run_asks_nothing(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(embedding_cache, "TASK_ROWS", 6)
    said = tmp_path / "calls"
    said.mkdir()
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    assert cache.entries().count() == 0 and cache.misses(chunks).count() == 11
    found = {r.id: r.vector for r in cache.embedded(chunks, Counted(said), batch=4).collect()}
    assert len(found) == 32 and sum(calls(said)) == 11 and max(calls(said)) <= 4
    assert found[3] == found[13] == Hashing(8).embed(["text 3"])[0] and found[30] == found[31] == [0.0] * 8
    before = len(calls(said))
    assert cache.fill(chunks, Counted(said)) == 0 and len(calls(said)) == before
    more = chunks.unionByName(spark.createDataFrame([(40, "new")], "id int, text string"))
    assert cache.fill(more, Counted(said)) == 1 and cache.entries().count() == 12


def test_entries_that_two_writers_append_are_one(spark, chunks, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    cache.fill(chunks, Hashing(8))
    cache.entries().write.mode("append").parquet(cache.folder)
    assert cache.entries().count() == 11 and cache.embedded(chunks, Hashing(8)).count() == 32


def test_transient_failures_are_tried_again_and_others_write_nothing(spark, chunks, tmp_path):
    for name, provider, number in (("a", {"failures": 2}, 11), ("b", {"failures": 3}, None), ("c", {"failures": 1, "error": ValueError}, None), ("d", {"short": True}, None)):
        said = tmp_path / f"calls-{name}"
        said.mkdir()
        cache = EmbeddingCache(spark, str(tmp_path / f"cache-{name}"))
        if number:
            assert cache.fill(chunks, Counted(said, **provider), wait=0.01) == number and len(calls(said)) == 3
        else:
            with pytest.raises(Exception, match="not now|vectors"):
                cache.fill(chunks, Counted(said, **provider), wait=0.01)
            assert len(calls(said)) == (3 if name == "b" else 1)
            assert cache.misses(chunks).count() == 11


def test_a_budget_is_checked_before_the_first_request(spark, chunks, tmp_path):
    said = tmp_path / "calls"
    said.mkdir()
    cache = EmbeddingCache(spark, str(tmp_path / "cache"))
    with pytest.raises(embedding_cache.TooManyRequests):
        cache.fill(chunks, Counted(said), batch=4, requests=8)
    assert calls(said) == [] and cache.fill(chunks, Counted(said), batch=4, requests=9) == 11
