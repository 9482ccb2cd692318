import hashlib
import math
import random

import numpy as np
import pytest

from lodestrata.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, q string, n string, cluster string, distance string"


def plain(rows, clusters=16, rounds=3, size=64):
    """The contract, read row by row."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) * 64 < centroids.LARGEST for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    own = lambda v: min((far(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        at = [own(v)[1] for _, v in kept]
        for c in range(len(centres)):
            few = [v for (_, v), a in zip(kept, at, strict=True) if a == c]
            if few:
                centres[c] = [sum(x) // len(few) for x in zip(*few, strict=True)]
    last = [(i, *own(v)) for i, v in kept]
    total = [sum(d for _, d, a in last if a == c) for c in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    held = lambda x: x if x < 1 << 63 else None
    return sorted([(i, a, d, held(total[a]), held(sum(total)), digest[a]) for i, d, a in last], key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in centroids.cluster(df, **how).collect()), key=repr)


def odd_rows(n, size=64, seed=5):
    """Few different vectors, one of them in a third of the rows, and rows that take no part."""
    draw = random.Random(seed)
    pool = [[draw.choice([-1.5, -0.25, -0.0, 0.0, 0.125, 0.75, 2.0]) for _ in range(size)] for _ in range(max(3, n // 3))]
    rows = [(i, pool[0] if i % 3 == 0 else draw.choice(pool)) for i in range(n)]
    bad = [None, [], [1.0] * (size - 1), [None] + [1.0] * (size - 1), [float("nan")] + [1.0] * (size - 1), [float("inf")] * size, [3e38] * size]
    return rows + [(1000 + i, v) for i, v in enumerate(bad)] + [rows[-1], rows[-1], (None, pool[1]), (None, pool[2]), (rows[0][0], pool[2])]


@pytest.mark.parametrize("n", [1, 9, 300])
def test_as_the_contract_says(spark, n):
    rows = odd_rows(n)
    assert run(spark, rows) == plain(rows)


def test_other_parameters(spark):
    rows = odd_rows(60, 3)
    assert run(spark, rows, clusters=4, rounds=6, dimension=3) == plain(rows, 4, 6, 3)


def test_hot_vectors_are_joined_by_broadcast_and_the_rest_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(centroids, "HOT", 10)
    rows = odd_rows(200)
    assert run(spark, rows) == plain(rows)


def test_large_numbers_are_exact(spark):
    draw = random.Random(1)
    rows = [(i, [draw.choice([-1, 1]) * (2.0**20 + draw.random() * 2**19) for _ in range(64)]) for i in range(40)]
    held = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows) == plain(held)


def test_nothing_takes_part(spark):
    assert run(spark, []) == run(spark, [(1, None), (2, [1.0])]) == []


def test_a_round_reads_distinct_vectors(spark, monkeypatch):
    seen = []
    own = centroids.lloyd
    monkeypatch.setattr(centroids, "lloyd", lambda groups, *rest: seen.append((groups.count(), groups.selectExpr("sum(n)").first()[0])) or own(groups, *rest))
    run(spark, [(i, [float(i % 4)] * 64) for i in range(400)])
    assert seen == [(4, 400)]


def test_query_and_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    for sf in ("sf0.001", "sf0.01"):
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
        held = duck.execute(queries.ORACLE_SQL["op13_centroid_clustering"])
        df = queries.QUERIES["op13_centroid_clustering"](spark, f"/root/testdata/{sf}").select(*[x[0] for x in held.description])
        assert sorted(map(tuple, df.collect())) == sorted(held.fetchall())
