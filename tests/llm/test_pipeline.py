import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lodestrata.llm import common, cotrain, queries, secrets

from . import cases, test_models, test_near, test_secrets

SF = "/root/testdata/sf0.001"


def redacted(text):
    spans, at, out = test_secrets.base(text), 0, ""
    for a, _, b in sorted(spans + test_secrets.extra(text, spans)):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_stages_are_the_plain_versions(spark, tmp_path):
    """Each stage's rows against a plain version of it over its own input."""
    docs = common.table(spark, SF, "documents")
    columns, held = docs.columns, [docs.collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        held.append(docs.collect())
    raw, quality, exact, near, clean = (sorted(x, key=lambda r: r.doc_id) for x in held)

    said = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    text = np.concatenate([cotrain.text_matrix(pa.array([r.text or ""])) for r in raw]).astype(float)
    meta = np.concatenate([cotrain.meta_matrix([r.source], [r.lang], [r.n_chars]) for r in raw]).astype(float)
    known = np.array([said.get(r.doc_id, np.nan) for r in raw], float)
    score = test_models.plain_quality(text, meta, known, np.array([zlib.crc32(b"held %d" % r.doc_id) % 4 == 0 for r in raw]))[2]
    sure = np.abs(score - cotrain.KEEP_FROM) > 1e-3
    assert {r.doc_id for r, p, s in zip(raw, score, sure, strict=True) if s and p >= cotrain.KEEP_FROM} == {r.doc_id for r in quality} - {r.doc_id for r, s in zip(raw, sure, strict=True) if not s}
    assert quality == [r for r in raw if r.doc_id in {x.doc_id for x in quality}]

    last = {}
    for r in quality:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    assert exact == [r for r in quality if last[r.text or ""] == r.doc_id]
    classes = {i: c for i, c, _, _ in test_near.brute([(r.doc_id, r.text or "") for r in exact])}
    assert near == [r for r in exact if classes[r.doc_id] == r.doc_id]
    assert [(r.doc_id, r.text) for r in clean] == [(r.doc_id, r.text and redacted(r.text)) for r in near]

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(queries._vocabulary_path())
    n = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in clean}
    length = Counter()
    for r in packed:
        length[r.doc_id] += r.length
    assert length == n
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(tuple(r)[:5] for r in packed)


def test_stages_stand_odd_rows(spark):
    for make in (cases.odd, cases.empty):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, make(spark), SF)
            assert make is cases.odd or found.count() == 0
            assert name == "quality classifier" or make is cases.empty or found.where("doc_id is null").count() == 1


def test_texts_that_share_an_id_stay_apart(spark):
    texts = ["one text", "another text", "one text"]
    docs = spark.createDataFrame([(1, t, "de", "s", len(t)) for t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        assert sorted(r.text for r in stage(spark, docs, SF).collect()) == ["another text", "one text"]


def test_nothing_is_left_to_redact(spark):
    docs = spark.createDataFrame(list(enumerate(test_secrets.texts())), "doc_id long, text string")
    assert secrets.secret_digests(corpus_pipeline.secret(spark, docs, SF)).where("n_access + n_hex > 0").count() == 0
