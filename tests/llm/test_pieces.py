import hashlib
import random

import numpy as np
import pytest

from lodestrata.llm import pieces, queries

from . import cases

sentencepiece = pytest.importorskip("sentencepiece")
PATH = queries._model_path()
BITS = [" ", "  ", "\n", "\t", "a", "B", "é", "é", "ﬁ", "½", "　", "\xa0", "▁", " the", " Wort", "", "日", "本", "12", "<s>", "</s>", "<unk>", "<0x41>", "\0", "\U0001f600", "﻿", "가", "ガ", "x" * 90, "ab" * 70, " " * 40]


def texts(seed=3, n=700):
    draw = random.Random(seed)
    return ["", " ", "   ", "▁", *cases.texts().values(), *("".join(draw.choices(BITS, k=draw.randint(1, 14))) for _ in range(n))]


def variant(**how) -> bytes:
    """The model with other settings, and with the library's own compiled character map."""
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    held = proto.ModelProto()
    with open(PATH, "rb") as file:
        held.ParseFromString(file.read())
    own = proto.NormalizerSpec()
    own.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec())
    if how.pop("map", False):
        held.normalizer_spec.precompiled_charsmap = own.precompiled_charsmap
    for name, value in how.items():
        setattr(held.normalizer_spec, name, value)
    return held.SerializeToString()


def library(data: bytes):
    return sentencepiece.SentencePieceProcessor(model_proto=data)


SETTINGS = [{}, {"map": True}, {"map": True, "remove_extra_whitespaces": True}, {"remove_extra_whitespaces": True}, {"add_dummy_prefix": False}, {"map": True, "add_dummy_prefix": False, "remove_extra_whitespaces": True}]


@pytest.mark.parametrize("how", SETTINGS, ids=str)
def test_ids_spans_and_text_are_the_librarys(how):
    data = variant(**how)
    own, lib = pieces.Model(data), library(data)
    encoder = pieces.Encoder(own, kept=300)
    said = texts()
    for at in range(0, len(said), 40):
        part = said[at : at + 40]
        ids, offsets, start, end = encoder.group([t.encode() for t in part])
        for text, a, b in zip(part, offsets, offsets[1:], strict=False):
            want = lib.encode(text, return_type="proto")
            assert ids[a:b].tolist() == [p.id for p in want.pieces], repr(text[:80])
            assert list(zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)) == [(p.begin, p.end) for p in want.pieces], repr(text[:80])
            assert own.decode(ids[a:b].tolist()).decode() == lib.decode(ids[a:b].tolist()), repr(text[:80])


def test_any_ids_decode_as_the_librarys():
    with open(PATH, "rb") as file:
        data = file.read()
    own, lib, draw = pieces.Model(data), library(data), random.Random(4)
    for _ in range(1500):
        ids = [draw.choice([draw.randrange(32_000), draw.randrange(3, 259), draw.randrange(130, 259), draw.randrange(3), 259, 28705]) for _ in range(draw.randint(0, 8))]
        assert own.decode(ids).decode() == lib.decode(ids), ids


def test_the_maps_longest_prefix_is_taken():
    own = pieces.Model(variant(map=True))
    assert own.map.longest("éx".encode(), 0) == ("é".encode(), 3)
    assert own.map.longest(b"ex", 0) is None
    said, places = own.normalise("xﬁ½".encode())
    assert said.decode() == "▁xfi1⁄2" and places.tolist() == [0, 0, 0, 0, 1, 1, 4, 4, 4, 4, 4, 6]


def test_long_texts_without_spaces_go_through_the_heap():
    with open(PATH, "rb") as file:
        own = pieces.Model(file.read())
    draw = random.Random(5)
    for n in (63, 64, 65, 400, 5000):
        cut = "".join(draw.choice("theandering") for _ in range(n))
        assert own.encode_cut(cut) == library(variant()).encode(cut)[1:] or own.encode_cut("▁" + cut) == library(variant()).encode(cut)


@pytest.mark.parametrize(("setting", "value"), [("model_type", 1), ("byte_fallback", False)])
def test_models_of_another_kind_are_refused(setting, value):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    held = proto.ModelProto()
    held.ParseFromString(variant())
    setattr(held.trainer_spec, setting, value)
    with pytest.raises(ValueError):
        pieces.Model(held.SerializeToString())


def test_round_trip(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = pieces.encode_decode(cases.odd(spark), PATH).collect()
    assert len(rows) == len(cases.rows())
    digest = lambda x: hashlib.sha256(x).hexdigest()
    for r in rows:
        if r.doc_id is not None:
            text = cases.texts()[r.doc_id]
            want = lib.encode(text, return_type="proto").pieces
            ids = [p.id for p in want]
            spans = np.array([(p.begin, p.end) for p in want], "<i8").tobytes()
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.spans_sha256) == (len(ids), digest(",".join(map(str, ids)).encode()), digest(lib.decode(ids).encode()), digest(spans))
    assert pieces.encode_decode(cases.empty(spark), PATH).count() == 0
    encoded = pieces.encode(cases.odd(spark), PATH)
    assert {r.doc_id: r.text for r in pieces.decode(encoded, PATH).collect() if r.doc_id is not None} == cases.texts()
    for r in encoded.collect():
        if r.doc_id is not None and r.ids:
            raw = cases.texts()[r.doc_id].encode()
            assert b"".join(raw[a:b] for a, b in zip(r.starts, r.ends, strict=True)) == raw


def test_query_gives_the_librarys_digests(spark):
    sf = "/root/testdata/sf0.001"
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op12_sentencepiece_round_trip"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
