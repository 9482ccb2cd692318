import random
import re
from collections import defaultdict

import numpy as np
import pytest

from lodestrata.llm import jaccard_forest
from lodestrata.llm.components import components

from . import cases


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    links, root = [0] * len(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 10 * len(x & y) >= 8 * len(x | y):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(least.get(find(n), i), i)
    copy = defaultdict(list)
    for i, s in sets:
        copy[frozenset(s)].append(i)
    return sorted((i, least[find(n)], min(copy[frozenset(s)]) if s else i, links[n]) for n, (i, s) in enumerate(sets))


def table(seed):
    draw = random.Random(seed)
    out = []
    for _ in range(8):
        text = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(3, 150))]
        for _ in range(draw.randint(1, 14)):
            copy = list(text)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                copy[draw.randrange(len(copy))] = f"w{draw.randint(0, 400)}"
            out.append((len(out), " ".join(copy)))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "block"), [(1, 4096), (2, 4)])
def test_links_and_classes(spark, seed, block, monkeypatch):
    monkeypatch.setattr(jaccard_forest, "BLOCK_SETS", block)
    rows = table(seed)
    found = jaccard_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r)[:4] for r in found) == brute(rows)


def test_odd_rows(spark):
    found = {r.doc_id: r for r in jaccard_forest.near_duplicates(cases.odd(spark)).collect()}
    assert sorted(i for i in found if i is not None) == sorted(cases.texts()) and tuple(found.pop(None))[:4] == (None, None, None, 0)
    want = {r[0]: r for r in brute([(r[0], r[1] or "") for r in cases.rows() if r[0] is not None])}
    assert {i: tuple(r)[:4] for i, r in found.items()} == want
    assert jaccard_forest.near_duplicates(cases.empty(spark)).count() == 0


def test_the_floor_is_where_the_recall_is_reached():
    assert jaccard_forest.floor_length(0.8, 0.99999, 24, 6) == 4
    assert jaccard_forest.floor_length(0.8, 0.9999, 24, 6) == 5
    assert jaccard_forest.floor_length(0.8, 0.5, 24, 6) == 6
    assert jaccard_forest.floor_length(0.5, 0.9999, 24, 6) == 1


def test_prefixes_are_shortened_until_the_measured_recall_is_reached(spark):
    enough = int(jaccard_forest.agreement(0.8)) + 1
    met = lambda *n: spark.createDataFrame([(i, -i, d, enough) for i, d in enumerate(d for d, k in zip((6, 5, 4), n, strict=True) for _ in range(k))] + [(0, 1, 4, 0)], "u long, v long, depth int, agree int")
    assert jaccard_forest.reached(met(100, 0, 0), 0.8, 0.99, 4) == 6
    assert jaccard_forest.reached(met(98, 1, 1), 0.8, 0.99, 4) == 5
    assert jaccard_forest.reached(met(90, 5, 5), 0.8, 0.99, 4) == 4
    assert jaccard_forest.reached(met(0, 0, 0), 0.8, 0.99, 4) == 4


def test_a_walk_meets_all_that_share_a_prefix_and_agree():
    draw = np.random.default_rng(8)
    sketch = jaccard_forest._sketches(draw.integers(0, 4, (4, jaccard_forest.TREES * jaccard_forest.DEPTH)).astype(np.uint16))
    own = draw.integers(0, 4, 300)
    places = jaccard_forest.Labels(draw.integers(0, 3, 300).astype(np.uint64), draw.integers(0, 2, (300, 2)).astype(np.uint16), np.arange(300), sketch[own]).sorted()
    edges, leaders = places.walk(4, jaccard_forest.Bounds.of(0.8))
    assert len(leaders) == len({(p, own[r]) for p, r in zip(places.prefix, places.rep, strict=True)})
    kind, prefix = own[places.rep], dict(zip(places.rep.tolist(), places.prefix.tolist(), strict=True))
    assert len(kind) == 300 and all(own[a] == own[b] and prefix[a] == prefix[b] for a, b, *_ in edges.tolist())
    assert len(edges) == 300 - len(leaders)


def test_texts_that_share_an_id_are_different_rows(spark):
    draw = random.Random(11)
    a, b = (" ".join(f"w{draw.randint(0, 4000)}" for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (1, a)]
    found = jaccard_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(tuple(r)[:4] for r in found) == brute(rows)
    assert sorted((r.doc_id, r.n_links) for r in found) == [(1, 1), (1, 2), (1, 2), (2, 2), (3, 1)]
    assert sorted((r.doc_id, r.n_links, r.stays) for r in found if r.doc_id == 1) == [(1, 1, True), (1, 2, True), (1, 2, True)]


def test_one_row_of_a_class_stays(spark):
    draw = random.Random(13)
    a = [f"w{draw.randint(0, 4000)}" for _ in range(60)]
    rows = [(1, " ".join(a)), (1, "  ".join(a)), (1, " ".join([*a, "x"])), (2, " ".join([*a, "y"])), (3, ""), (3, " "), (4, "other")]
    found = jaccard_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).where("stays").collect()
    assert sorted(r.doc_id for r in found) == [1, 3, 3, 4]


def test_a_large_group_of_near_copies(spark):
    """Different texts that are all linked: leaders stand for them, and blocks count their links."""
    draw = random.Random(12)
    text = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(600):
        copy = list(text)
        copy[draw.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    found = jaccard_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert sorted(tuple(r)[:4] for r in found) == brute(rows)


def test_components(spark):
    draw = random.Random(6)
    edges = [(i, i + 1) for i in range(30)] + [(100 + draw.randint(0, 40), 100 + draw.randint(0, 40)) for _ in range(30)] + [(500, x) for x in range(501, 520)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    own = {x for a, b in edges if a != b for x in (a, b)}
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: find(x) for x in own}


@pytest.mark.parametrize("copies", [2, 3])
def test_empty_blocks_count_nothing(spark, copies, monkeypatch):
    monkeypatch.setattr(jaccard_forest, "BLOCK_SHINGLES", 40)
    draw = random.Random(copies)
    rows = []
    for _ in range(12):
        text = [f"w{draw.randint(0, 4000)}" for _ in range(90)]
        rows += [(len(rows) + n, " ".join([*text, *["end"] * n])) for n in range(copies)]
    found = jaccard_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r)[:4] for r in found) == brute(rows)
    assert {r.n_links for r in found} == {copies - 1}


@pytest.mark.parametrize("size", [8, 64, 1024, 4096])
def test_words_that_defeat_polynomials_are_different(spark, size):
    bits = [bin(i).count("1") % 2 for i in range(size)]
    one, other = ("".join(x[b] for b in bits) for x in ("ab", "ba"))
    rows = [(1, " ".join([one] * 5)), (2, " ".join([other] * 5)), (3, " ".join([one] * 5))]
    found = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in jaccard_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (1, 1, 1), 2: (2, 2, 0), 3: (1, 1, 1)}
