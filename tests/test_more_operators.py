"""Unit cases of merging, extraction, providers and sidecars."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import providers
from lodestrata.functions import text as T
from lodestrata.operators import extract, releases, vectors
from lodestrata.sources import sidecars


def test_tags_are_merged_and_padded(spark):
    own = spark.createDataFrame([("v26.9.0", 0), ("latest", 1)], "tag_name string, ord int")
    tags = spark.createDataFrame([("26.9", 0), ("26.10", 1), ("v26.10.0", 2), ("25.1", 3), ("27", 4)], "tag_name string, ord int")
    assert [(r.tag_name, r.source) for r in releases.merge_newer_tags(own, tags).orderBy("ord").collect()] == [("26.10", "tag"), ("v26.9.0", "release"), ("latest", "release")]
    assert releases.merge_newer_tags(own.where("ord = 1"), tags).count() == 1
    assert [r.tag_name for r in releases.pad_with_older_tags(own, tags, 4).collect()] == ["v26.9.0", "latest", "26.10", "25.1"]


def test_sections_are_merged(spark):
    p = spark.createDataFrame([("install", "faq text", True), ("formats", "f", False)], "section string, text string, faq_only boolean")
    f = spark.createDataFrame([("install", "real"), ("formats", "g"), ("support", "s")], "section string, text string")
    assert {r.section: (r.text, r.origin) for r in releases.merged_sections(p, f).collect()} == {"install": ("real", "fallback"), "formats": ("f", "primary"), "support": ("s", "fallback")}


def test_dead_branches():
    source = "a\n#if 0\nb\n#if X\nc\n#endif\n#else\nd\n#endif\n#if X && false\ne\n#elif Y\nf\n#endif"
    assert [x for x in extract.without_dead_branches(source).split("\n") if x and "#" not in x] == ["a", "d", "f"]


def test_comments(spark):
    rows = spark.createDataFrame([("/**\n * Opens a <b>file</b>\n * now. Then more.\n */",), ("/// Old. Deprecated: use `NewOne` instead.",)], "c string").select(extract.first_sentence("c").alias("s"), extract.deprecation("c").alias("d")).collect()
    assert [r.s for r in rows] == ["Opens a file now.", "Old."]
    assert [tuple(r.d) for r in rows] == [(False, None), (True, "NewOne")]


def test_interfaces_and_marks(spark):
    types = spark.createDataFrame([("A", ["IDisposable", "IEnumerable<int>"]), ("ns.B", [])], "name string, bases array<string>")
    members = spark.createDataFrame([("A", "Dispose")], "owner string, member string")
    assert [tuple(r) for r in extract.implied_members(types, members).collect()] == [("A", "GetEnumerator", "IEnumerable")]
    said = spark.createDataFrame([("`B` is not supported\n`A` works",)], "text string")
    assert {r.name: r.unsupported for r in extract.mark_unsupported(types, said).collect()} == {"A": False, "ns.B": True}
    assert {r.name: r.n for r in extract.mentions(said, types).collect()} == {"A": 1}


def test_verdicts_and_artifacts(spark):
    v = spark.createDataFrame([(False, None, None, None), (True, False, None, None), (True, True, 1, 5), (True, True, 0, 0), (True, True, 0, 9)], "c boolean, r boolean, e int, b int")
    assert [x[0] for x in v.select(extract.run_verdict(*map(F.col, "creb"))).collect()] == ["not_compiled", "not_run", "failed", "no_output", "ran"]
    assert [extract.artifact_problem(n, c) for n, c in (("a.pdf", b"%PDF-1.7 x %%EOF"), ("a.pdf", b"x"), ("a.zip", b"x"), ("a.txt", b"x"), ("a.png", b""))] == [None, "no PDF", "no ZIP", None, "empty"]


def test_providers_agree_with_the_expression(spark):
    own = providers.load("hashing")
    df = spark.createDataFrame([("a b b",), ("",), (None,)], "text string")
    rows = providers.embedded(df, own).withColumn("w", vectors.hash_embedding(T.plain_tokens(F.coalesce("text", F.lit(""))))).collect()
    assert all(max(abs(x - y) for x, y in zip(r.vector, r.w, strict=True)) < 1e-12 for r in rows)
    assert providers.embedded(df, own, F.col("text") == "a b b").count() == 1
    with pytest.raises(ValueError, match="no such provider"):
        providers.load("nothing")


def test_sidecars(spark):
    code = "x = 1\n"
    good = spark.range(1).select(T.code_hash(F.lit(code))).first()[0]
    rows = [("p", "a", "d", code, good), ("p", "b", "d", code, "0"), ("p", "b", "d", "...", None)]
    found = sidecars.example_problems(spark.createDataFrame(rows, "pilot string, title string, description string, code string, code_sha256 string")).collect()
    assert sorted((r.title, r.problem) for r in found) == [("b", "a placeholder in the code"), ("b", "a title twice"), ("b", "the digest is not the code's"), ("b", "the digest is not the code's")]
    defects = spark.createDataFrame([("d1", "class", ["A"], "s", "open", "2026-01-01"), ("d2", "thing", [], "", "open", "soon")], "defect_id string, kind string, refs array<string>, summary string, status string, verified_on string")
    assert {(r.defect_id, r.problem) for r in sidecars.defect_problems(defects).collect()} == {("d2", p) for p in ("blank summary", "an unknown kind", "no references", "no date of verification")}
    old = spark.createDataFrame([("r", "h", "c", "p", "t", 1), ("r", "g", "c", "p", "t", 1)], "provenance string, code_sha256 string, library_commit string, platform string, toolchain string, exit_code int")
    assert sorted(r.exit_code for r in sidecars.merged_verdicts(old, old.where("code_sha256 = 'h'").withColumn("exit_code", F.lit(0))).collect()) == [0, 1]
