import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lodestrata.llm import queries, tandem

from . import cases


def plain_runs(s, least=24, exponent=3):
    """All runs, by walking along each period."""
    n, out = len(s), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, exponent * q):
                w = s[i : i + size]
                if not any(w[d:] == w[:-d] for d in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def blank_split(text):
    out, word = [], ""
    for c in text:
        if c in " \t\n\v\f\r":
            out, word = out + [word] if word else out, ""
        else:
            word += c
    return out + [word] if word else out


def plain(doc_id, text, reorder=True):
    """The contract, read word by word."""
    words = blank_split(text or "")
    n = len(words)
    if doc_id is not None and n and reorder:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def strings(seed, count):
    draw = random.Random(seed)
    for turn in range(count):
        letters = draw.choice([1, 2, 3, 4])
        if turn % 3 == 0:
            yield [draw.randrange(letters) for _ in range(draw.randint(0, 60))]
        elif turn % 3 == 1:
            w = [draw.randrange(4) for _ in range(draw.randint(1, 8))]
            noise = lambda: [draw.randrange(4) for _ in range(draw.randint(0, 9))]
            yield noise() + w * draw.randint(1, 7) + w[:2] + noise() + w * 3 + noise()
        else:
            a, b = [0], [0, 1]
            while len(b) < 90:
                a, b = b, b + a
            yield b[draw.randint(0, 9) : draw.randint(20, 90)]


@pytest.mark.parametrize(("least", "exponent"), [(1, 2), (3, 2), (6, 3)])
def test_runs_are_those_of_the_walk(least, exponent):
    for s in strings(least, 900):
        assert [tuple(map(int, r)) for r in zip(*tandem.runs(np.array(s, np.int64), least, exponent), strict=True)] == plain_runs(s, least, exponent), s


def test_vocabulary_has_every_square_whose_half_is_no_repetition():
    for s in strings(8, 400):
        if len(s) > 1:
            text = tandem.Suffixes(np.array(s, np.int64))
            place, period = tandem.vocabulary(text, *tandem.covering(text, len(s) // 2))
            found = [tuple(s[i : i + 2 * q]) for i, q in zip(place.tolist(), period.tolist(), strict=True)]
            squares = {tuple(s[i : i + 2 * q]) for q in range(1, len(s) // 2 + 1) for i in range(len(s) - 2 * q + 1) if s[i : i + q] == s[i + q : i + 2 * q]}
            whole = {w for w in squares if not any(len(w) // 2 % d == 0 and w[d:] == w[:-d] for d in range(1, len(w) // 2))}
            assert len(found) == len(set(found)) and set(found) == whole, s


def test_blocks_are_the_longest_that_begin_earlier():
    for s in strings(2, 200):
        if s:
            at, want = 0, []
            while at < len(s):
                want.append(at)
                at += max([size for size in range(1, len(s) - at + 1) if any(s[j : j + size] == s[at : at + size] for j in range(at))], default=1)
            assert tandem.Suffixes(np.array(s, np.int64)).blocks().tolist() == want


@pytest.mark.parametrize("group", [30, 1 << 17])
def test_stretches_lose_no_run(group, monkeypatch):
    monkeypatch.setattr(tandem, "GROUP", group)
    draw = random.Random(group)
    for least, exponent in ((24, 3), (20, 4), (7, 2)) * 60:
        docs = []
        for _ in range(draw.randint(1, 6)):
            s, size = [], draw.randint(0, 150)
            while len(s) < size:
                w = [draw.randrange(draw.choice([2, 4, 50])) for _ in range(draw.randint(1, 20))]
                s += w * draw.choice([1, 1, 2, 3, 5]) + w[: draw.randint(0, len(w))]
            docs.append(s)
        offsets = np.cumsum([0, *map(len, docs)])
        ids = np.array([x for s in docs for x in s], np.int64)
        found = tandem.document_runs((ids % 3).astype(np.uint64), offsets, lambda a, b, ids=ids: ids[a:b], least, exponent)  # keys that different words share
        assert [tuple(map(int, r)) for r in zip(*found, strict=True)] == [(a + int(o), b, c) for s, o in zip(docs, offsets, strict=False) for a, b, c in plain_runs(s, least, exponent)]


def test_long_texts():
    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    assert len(tandem.runs(np.array(b, np.int64))[0]) > 1000
    start, length, period = tandem.runs(np.zeros(400_000, np.int64))
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [400_000], [1])
    start, length, period = tandem.runs(np.tile(np.random.default_rng(1).permutation(60_000), 4)[:-7])
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [239_993], [60_000])


REPEATED = ["ha " * 24, "ha " * 23, "eins zwei drei " * 9 + "vier", "x " * 30 + "y z " * 20, "  a \u0085 a" * 12, "a b c\td\n" * 6, "Ende. " * 40 + cases.LINE, "a b " * 30]


def test_as_the_contract_says(spark):
    rows = cases.rows() + [(100 + i, t, None, None, None, None, None, None, None) for i, t in enumerate(REPEATED * 12)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    found = sorted((tuple(r) for r in tandem.run_digests(df, tandem.planted).collect()), key=repr)
    want = {(r[0], r[1]): plain(r[0], r[1]) if r[1] != cases.LONG and r[1] != cases.LONG + " Ende" else None for r in rows}
    ids = {k[0] for k, v in want.items() if v is None}  # too long for the walk; below
    assert [r for r in found if r[0] not in ids] == sorted((want[r[0], r[1]] for r in rows if want[r[0], r[1]]), key=repr)
    assert len([r for r in found if r[0] in ids]) == 3
    assert tandem.run_digests(cases.empty(spark)).count() == tandem.collapse_runs(cases.empty(spark)).count() == 0


def test_collapsed_texts_keep_one_period(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*REPEATED, None, "no  runs\there"])], "doc_id long, text string")
    found = {r.doc_id: r for r in tandem.collapse_runs(df).collect()}
    assert found[0].text == "ha" and [tuple(x) for x in found[0].runs] == [(0, 24, 1)]
    assert found[1].text == REPEATED[1] and found[1].runs == []
    assert found[2].text == "eins zwei drei vier" and found[3].text == "x y z"
    assert found[len(REPEATED)].text == "" and found[len(REPEATED) + 1].text == "no  runs\there"
    assert found[5].text == "a b c d"


def test_query_over_the_smallest_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = queries.QUERIES["op11_periodic_runs"](spark, sf).collect()
    short = {r.doc_id for r in rows if len(r.text or "") < 9000}
    assert len(found) == len(rows)
    assert sorted((tuple(r) for r in found if r.doc_id in short), key=repr) == sorted((plain(r.doc_id, r.text) for r in rows if r.doc_id in short), key=repr)
    assert any(r.n_runs for r in found)
