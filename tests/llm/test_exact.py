import hashlib
from collections import Counter

import pytest

from lodestrata.llm import exact_lsm

from . import cases


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_groups_as_a_plain_dictionary_does(spark, keep):
    found = exact_lsm.exact_dedup(cases.odd(spark), keep, memtable_bytes=1000, fanout=2).collect()
    rows = [(r[0], r[1] or "") for r in cases.rows() if r[0] is not None]
    size = Counter(t for _, t in rows)
    best = {t: (max if keep == "largest" else min)(i for i, x in rows if x == t) for t in size}
    want = sorted((i, best[t], size[t], i == best[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted(tuple(r) for r in found if r.doc_id is not None) == want
    assert [tuple(r) for r in found if r.doc_id is None] == [(None, None, 1, True, hashlib.sha256(b"no id").hexdigest())]


def test_empty_table(spark):
    assert exact_lsm.exact_dedup(cases.empty(spark)).count() == 0


def test_one_digest_of_two_texts_is_an_error():
    index = exact_lsm.MergeIndex()
    index.add(b"d" * 32, 1, 1, b"a")
    with pytest.raises(ValueError, match="share the digest"):
        index.add(b"d" * 32, 2, 2, b"b")
    index = exact_lsm.MergeIndex()
    for i, text in enumerate((b"a", b"b")):
        index.add(b"d" * 32, i, i, text)
        index.flush()
    with pytest.raises(ValueError, match="share the digest"):
        list(index.drain())


def test_runs_are_merged_within_a_task():
    index = exact_lsm.MergeIndex(memtable_bytes=1)
    for i in range(6):
        index.add(bytes([i % 2]) * 32, -i, i, b"t%d" % (i % 2))
    assert len(index.runs) == 6
    rows = list(index.drain())
    assert sorted((doc, ident) for doc, _, ident, _, _ in rows) == [(0, -4), (1, -5), (2, -4), (3, -5), (4, -4), (5, -5)]
    assert [n for *_, n, head in rows if head] == [3, 3]


def test_two_texts_of_one_id_do_not_clash(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (3, "b"), (4, "c"), (1, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    size, best = Counter(t for _, t in rows), {"a": 2, "b": 3, "c": 4}
    want = sorted((i, best[t], size[t], i == best[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted(map(tuple, exact_lsm.exact_dedup(df, "largest").collect())) == want
