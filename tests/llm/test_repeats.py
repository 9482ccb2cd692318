import hashlib
import random
import re

import numpy as np
import pytest

from lodestrata.llm import anchors, seed_extend, suffix_dedup

from . import cases


def brute(rows, window, units):
    first = {}
    for doc_id, symbols in rows:
        for i in range(len(symbols) - window + 1):
            key = tuple(symbols[i : i + window])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, symbols in rows:
        gone = [False] * len(symbols)
        for i in range(len(symbols) - window + 1):
            if first[tuple(symbols[i : i + window])] < doc_id:
                gone[i : i + window] = [True] * window
        out.append((doc_id, gone))
    return out


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def table(seed):
    draw = random.Random(seed)
    passages = [" ".join(draw.choices(["ab", "ba", "abab", "c", "é", "dd"], k=draw.randint(5, 40))) for _ in range(6)]
    return [(draw.randint(0, 60), draw.choice([" ", "\n", ""]).join(draw.choices([*passages, "z", "aaaa" * 20, ""], k=draw.randint(0, 4)))) for _ in range(70)]


@pytest.mark.parametrize("seed", range(2))
def test_bytes(spark, seed, monkeypatch):
    monkeypatch.setattr(anchors, "CHUNK", 700)
    rows = table(seed) + [(i, t) for i, t in cases.texts().items() if len(t) < 2000]
    got = sorted(map(tuple, suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    want = []
    for (doc_id, gone), (_, text) in zip(brute([(i, t.encode()) for i, t in rows], 50, None), rows, strict=True):
        held = text.encode()
        kept = bytes(b for b, g in zip(held, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((doc_id, len(held), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_words(spark, seed, monkeypatch):
    monkeypatch.setattr(anchors, "CHUNK", 700)
    rows = table(seed + 10) + list(cases.texts().items())
    got = sorted(map(tuple, seed_extend.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()))
    want = []
    for (doc_id, gone), (_, text) in zip(brute([(i, words(t)) for i, t in rows], 13, None), rows, strict=True):
        kept = [w for w, g in zip(words(text), gone, strict=True) if not g]
        want.append((doc_id, len(gone), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    assert got == sorted(want)


@pytest.mark.parametrize("remove", [suffix_dedup.remove_repeats, seed_extend.remove_repeats])
def test_odd_rows(spark, remove):
    found = remove(cases.odd(spark)).collect()
    bare = [r for r in found if r.doc_id is None]
    found = [r for r in found if r.doc_id is not None]
    assert [(r[1] in (2, 5), r.n_removed, r.kept_sha256) for r in bare] == [(True, 0, hashlib.sha256(b"no id").hexdigest())]
    assert sorted(r.doc_id for r in found) == sorted(r[0] for r in cases.rows() if r[0] is not None)
    assert {r.doc_id: r.n_removed > 0 for r in found} == {i: i in (5, 6, 8, 11, 12) for i in cases.texts()}
    assert remove(cases.empty(spark)).count() == 0


def test_suffix_array_is_the_sorted_suffixes():
    draw = random.Random(4)
    for _ in range(400):
        text = [draw.randint(1, draw.choice([1, 2, 3, 26])) for _ in range(draw.randint(0, 50))] + [0]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_every_window_has_one_anchor():
    draw = np.random.default_rng(1)
    data = draw.integers(97, 100, 900).astype(np.uint8)
    offsets = np.array([0, 10, 10, 59, 110, 900])
    row, anchor, start, number, _ = anchors.seeds(*anchors.cut_bytes(data, offsets)[::2], 50, 25)
    assert sum(number) == sum(max(0, b - a - 49) for a, b in zip(offsets, offsets[1:], strict=False))
    assert all(s <= a and a + 25 <= s + n - 1 + 50 for a, s, n in zip(anchor, start, number, strict=True))


@pytest.mark.parametrize("stretch", [50, 51, 64, 333])
def test_stretches_of_a_row_give_the_same_anchors(stretch, monkeypatch):
    data = np.random.default_rng(2).integers(97, 99, 900).astype(np.uint8)
    offsets = np.array([0, 10, 10, 59, 110, 900])
    whole = anchors.seeds(*anchors.cut_bytes(data, offsets)[::2], 50, 25)
    monkeypatch.setattr(anchors, "STRETCH", stretch)
    for a, b in zip(whole, anchors.seeds(*anchors.cut_bytes(data, offsets)[::2], 50, 25), strict=True):
        assert a.tolist() == b.tolist()


@pytest.mark.parametrize(("cut", "window", "gram"), [(anchors.cut_bytes, 50, 25), (anchors.cut_words, 13, 5)])
def test_anchors_beyond_24_bits_are_those_of_the_tail_alone(cut, window, gram):
    draw = np.random.default_rng(3)
    tail = draw.integers(97, 123, 4000).astype(np.uint8)
    head = draw.integers(97, 123, (1 << 24) + 500).astype(np.uint8)
    if cut is anchors.cut_words:
        head, tail = (np.stack([x, np.full(len(x), 32, np.uint8)], 1).ravel() for x in (head, tail))
    whole = np.concatenate([head, tail])
    values, _, at = cut(whole, np.array([0, len(whole)]))
    _, anchor, start, number, found = anchors.seeds(values, at, window, gram)
    assert number.sum() == at[-1] - window + 1 and (anchor >= start).all() and (anchor - start <= window - gram).all()
    values, _, at = cut(tail, np.array([0, len(tail)]))
    _, own_anchor, own_start, own_number, own_found = anchors.seeds(values, at, window, gram)
    n, shift = len(own_anchor) - 1, (1 << 24) + 500
    assert (anchor[-n:] - shift).tolist() == own_anchor[1:].tolist() and (start[-n:] - shift).tolist() == own_start[1:].tolist()
    assert number[-n:].tolist() == own_number[1:].tolist() and found[-n:].tolist() == own_found[1:].tolist()


def test_a_repeat_behind_16_mib_goes(spark):
    tail = " ".join(hashlib.md5(b"tail %d" % i).hexdigest() for i in range(30))
    filler = "concat_ws(' ', transform(sequence(1, 520000), i -> md5(cast(i as string))))"
    long = spark.sql(f"SELECT 1L AS doc_id, concat({filler}, ' {tail} ', md5('between'), ' {tail}') AS text UNION ALL SELECT 2L, '{tail}' UNION ALL SELECT 0L, '{tail[:400]}'")
    found = {r.doc_id: r for r in suffix_dedup.remove_repeats(long).collect()}
    assert found[1].n_bytes > 1 << 24
    assert (found[0].n_removed, found[1].n_removed, found[2].n_removed) == (0, 800, len(tail))


def test_classes_are_of_equal_symbols_whatever_the_hashes():
    draw = np.random.default_rng(9)
    size = draw.integers(1, 4, 500)
    offset = np.cumsum(size) - size
    symbols = draw.integers(0, 2, int(size.sum())).astype(np.uint8)
    key, doc_id = draw.integers(0, 3, 500).astype(np.uint64), draw.integers(0, 50, 500)
    heads, group = anchors.classes(key, doc_id, np.zeros(500, np.uint64), offset, size, symbols)
    own = [(int(k), symbols[a : a + n].tobytes()) for k, a, n in zip(key, offset, size, strict=True)]
    assert all(own[heads[g]] == x for g, x in zip(group, own, strict=True)) and len({own[h] for h in heads}) == len(heads)
    assert all(doc_id[heads[g]] <= d for g, d in zip(group, doc_id, strict=True)) and (np.diff(key[heads].astype(int)) >= 0).all()


def test_a_line_in_every_document(spark):
    """One line that all documents hold, between texts of their own: its anchors are hot."""
    line = " ".join(hashlib.md5(b"line %d" % i).hexdigest() for i in range(5))
    rows = [(i, f"{hashlib.sha512(b'a%d' % i).hexdigest()} {line} {hashlib.sha512(b'b%d' % i).hexdigest()}") for i in range(800)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    want = {d: sum(g) for d, g in brute([(i, t.encode()) for i, t in rows], 50, None)}
    assert {r.doc_id: r.n_removed for r in found} == want


def test_a_window_that_is_too_wide_is_an_error(spark):
    with pytest.raises(ValueError, match="window"):
        suffix_dedup.remove_repeats(cases.odd(spark), window=1 << 16)


def test_wide_windows(spark):
    rows = [(0, "x" * 300 + "abc" * 200), (1, "abc" * 200 + "y" * 10), (2, "abc" * 100)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=400).collect()}
    assert got == {d: sum(g) for d, g in brute([(i, t.encode()) for i, t in rows], 400, None)}


def thue_morse(size):
    """Two words of so many letters whose hashes are one under any polynomial modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [8, 9, 64, 65, 1024, 4096])
def test_words_that_defeat_polynomials_stay(spark, size):
    lead = " ".join(f"w{i}" for i in range(12))
    one, other = thue_morse(size)
    rows = [(1, f"{lead} {one}"), (2, f"{lead} {other}"), (3, f"{lead} {one}")]
    found = {r.doc_id: r.n_removed for r in seed_extend.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 0, 2: 0, 3: 13}


def test_digests_of_words_are_of_their_bytes_only():
    draw = random.Random(3)
    said = [bytes(draw.choices(b"abc", k=draw.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 200]))) for _ in range(4000)]
    for gap in (b" ", b"\n\t "):
        data = np.frombuffer(gap + gap.join(said), np.uint8)
        values = anchors.cut_words(data, np.array([0, len(data)]))[0].tolist()
        assert len(values) == len(said) and len(set(values)) == len(set(said)) == len(set(zip(said, values, strict=True)))
        if gap == b" ":
            first = values
    assert first == values
