"""Embedding providers: what turns texts into vectors, named in a registry."""

from __future__ import annotations

import hashlib
import importlib
import math
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Transient(Exception):
    """A provider's failure that may pass: it may be asked again."""


class Hashing:
    """Token counts by digest, at unit length; needs no model."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimension
            for token in re.findall("[a-z0-9]+", text.lower()):
                v[int.from_bytes(hashlib.sha256(token.encode()).digest()[:8]) % self.dimension] += 1
            length = math.sqrt(sum(x * x for x in v))
            out.append([x / length for x in v] if length else v)
        return out


REGISTRY = {"hashing": Hashing}


def load(spec: str) -> Provider:
    """A provider by its alias or as `module:Class`."""
    if spec in REGISTRY:
        return REGISTRY[spec]()
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError(f"no such provider: {spec}")
    return getattr(importlib.import_module(module), name)()


def embedded(chunks: DataFrame, provider: Provider, include: Column | None = None, text: str = "text", decimals: int | None = None) -> DataFrame:
    """chunks with a column vector; the filter stands below the provider, so what it leaves out is never embedded."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors = provider.embed([t or "" for t in batch])
            yield pd.Series([v if decimals is None else [round(x, decimals) for x in v] for v in vectors])

    kept = chunks if include is None else chunks.where(include)
    return kept.withColumn("vector", embed(text))
