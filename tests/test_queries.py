"""Every query runs on the smallest tables; those with SQL give what DuckDB gives."""

from __future__ import annotations

import math

import pytest

from lodestrata.plans import catalog

from .conftest import SF

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    own = duckdb.connect()
    for name in TABLES:
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return own


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return int(value) if isinstance(value, bool) is False and hasattr(value, "__index__") else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in catalog.SQL:
        held = duck.execute(catalog.SQL[name])
        columns = [x[0] for x in held.description]
        assert sorted(columns) == sorted(df.columns)
        assert table(df.columns, map(tuple, rows)) == table(columns, held.fetchall())


def test_flagship(spark):
    assert 0 < catalog.flagship(spark, SF).count() <= 10
