import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.llm import bpe, common, packing, queries

from . import cases

tokenizers = pytest.importorskip("tokenizers")
PATH = queries._vocabulary_path()
PIECES = [" ", "  ", "\n", "\t", "a", "B", "é", "×", "'s", "'ll", "1", "²", ".", "?!", "\xa0", "　", "\x1c", "日", " the", "<|endoftext|>", "ab" * 200]


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(PATH)


def texts() -> list[str]:
    draw = random.Random(3)
    return ["", *cases.texts().values(), *("".join(draw.choices(PIECES, k=draw.randint(1, 16))) for _ in range(1500))]


def test_chunks_that_share_a_hash_are_encoded_apart(reference, monkeypatch):
    said = ["the cat sat", "a dog ran off", "", "é 日本"]
    monkeypatch.setattr(bpe.TextEncoder, "_hash", lambda self, data, starts: (np.zeros(len(starts), np.uint64), np.diff(np.append(starts, len(data)))))
    encoder = bpe.TextEncoder(bpe.vocabulary(PATH))
    found = [ids[a:b].tolist() for ids, at, *_ in encoder.batch(*common.utf8(pa.array(said))) for a, b in zip(at, at[1:], strict=False)]
    assert found == [reference.encode(t, add_special_tokens=False).ids for t in said]


def test_ids_and_text_are_the_librarys(reference):
    said = texts()
    encoder = bpe.TextEncoder(bpe.vocabulary(PATH), kept=500, size=4000)
    found = [ids[a:b].tolist() for ids, at, *_ in encoder.batch(*common.utf8(pa.array(said))) for a, b in zip(at, at[1:], strict=False)]
    for text, ids in zip(said, found, strict=True):
        want = reference.encode(text, add_special_tokens=False).ids
        assert ids == want == bpe.vocabulary(PATH).encode(text), repr(text[:60])
        assert bpe.vocabulary(PATH).decode(ids).decode("utf-8", "replace") == reference.decode(want, skip_special_tokens=False)


def test_round_trip(spark, reference):
    rows = bpe.encode_decode(cases.odd(spark), PATH).collect()
    assert len(rows) == len(cases.rows())
    for r in rows:
        if r.doc_id is not None:
            text = cases.texts()[r.doc_id]
            ids = reference.encode(text, add_special_tokens=False).ids
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode_decode(cases.empty(spark), PATH).count() == 0
    both = bpe.decode(bpe.encode(cases.odd(spark), PATH), PATH).collect()
    assert {r.doc_id: r.text for r in both if r.doc_id is not None} == cases.texts()


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece_once_and_is_near_the_bound(seed):
    draw = random.Random(seed)
    lengths = Counter(draw.choice([draw.randint(1, 1024), draw.randint(1, 60), 1024, 512, 341]) for _ in range(draw.choice([3, 50, 4000])))
    patterns = packing.plan(lengths, 1024)
    used = Counter()
    for content, n in patterns:
        assert sum(content) <= 1024 and n > 0
        for length in content:
            used[length] += n
    assert used == lengths
    bins, bound = sum(n for _, n in patterns), -(-sum(k * n for k, n in lengths.items()) // 1024)
    assert bins <= max(bound + 3, 1.25 * bound)


def exact_bins(lengths: list[int], capacity: int) -> int:
    """The least number of bins, by search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def go(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                rest = list(rooms)
                rest.remove(room)
                go(i + 1, [*rest, room - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best


def test_the_reduction_never_costs_a_bin():
    draw = random.Random(9)
    for _ in range(150):
        lengths = [draw.randint(1, 20) for _ in range(draw.randint(1, 8))]
        counts = Counter(lengths)
        fixed = packing.reduce_instance(counts, 20)
        assert sum(n for _, n in fixed) + exact_bins(list(counts.elements()), 20) == exact_bins(lengths, 20), lengths


def test_sequences(spark, reference):
    rows = packing.pack_documents(cases.odd(spark), PATH).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for doc_id, text in cases.texts().items():
        ids = np.array([*reference.encode(text, add_special_tokens=False).ids, 2], "<u4")
        copies = sum(1 for r in cases.rows() if r[0] == doc_id)
        own = sorted(by_doc[doc_id], key=lambda r: (r.piece, r.sequence_id, r.offset))[::copies]
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == 1024 or r.piece == 0
            at += r.length
        assert at == len(ids)
    held: dict = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(cases.empty(spark), PATH).count() == 0


def test_patterns_follow_the_lengths_not_the_pieces():
    assert len(packing.plan({600: 100_000, 420: 100_000, 205: 100_000}, 1024)) < 20
    draw = np.random.default_rng(4)
    for pieces in (draw.integers(1, 1025, 10_000_000), np.minimum(draw.geometric(1 / 300, 10_000_000), 1024), draw.choice([600, 420, 205, 400, 212, 101], 10_000_000)):
        lengths = {int(k): int(n) for k, n in zip(*np.unique(pieces, return_counts=True), strict=True)}
        patterns = packing.plan(lengths, 1024)
        assert len(patterns) < 8 * 1024
        used = Counter()
        for content, n in patterns:
            used.update({k: times * n for k, times in Counter(content).items()})
        assert used == lengths
