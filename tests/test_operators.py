"""Unit cases of the operators: what each must do with odd input."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import grammar, predicates, versions
from lodestrata.functions import text as T
from lodestrata.operators import budget, chunking, claims, graph, lexical, quality, surface, symbols, vectors
from lodestrata.plans import publish, tools
from lodestrata.sources import readers
from lodestrata.streaming import telemetry

from .conftest import SF


def one(spark, column, **values):
    """A column's value over one row."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("word", "stem"), [("installations", "install"), ("installing", "install"), ("ring", "ring"), ("pages", "page"), ("images", "image"), ("boxes", "box"), ("classes", "class"), ("entries", "entry"), ("class", "class"), ("red", "red"), ("merged", "merg"), ("is", "is")])
def test_stem(spark, word, stem):
    assert one(spark, T.stem("w"), w=word) == stem


def test_canon(spark):
    assert [one(spark, T.canon("w"), w=w) for w in ("merge", "merging", "Vertices", "quickly")] == ["merg", "merg", "vertex", "quick"]


def test_tokens(spark):
    assert one(spark, T.tokens("t"), t="The AddPDFPage2 of foo_bar isn't") == ["addpdfpage2", "foo", "bar", "isn", "t", "add", "pdf", "page", "2"]
    assert one(spark, T.tokens("t"), t="") == []
    assert one(spark, T.required_terms("t"), t="use getValue, set_password and PDF in Pdf2Image") == ["getvalue", "set", "password", "pdf2image"]
    assert one(spark, T.stemmed_terms("t"), t="the PDFs' x of Joe's files") == ["pdf", "joe", "file"]
    assert one(spark, T.symbol_words("t"), t="ns::ITexture2D.Microsoft3MFFormat") == ["ns", "i", "texture", "2d", "microsoft", "3mf", "format"]


def test_query_shape(spark):
    assert [one(spark, T.query_shape("q"), q=q) for q in ("", "a b", "Foo", "a.b", "foo")] == ["empty", "phrase", "exact_fqn", "exact_fqn", "keyword"]


def test_neutralised(spark):
    text = "see `Known` and `Other`\n```\n`Other`\n```\n`x`"
    assert one(spark, T.neutralised(F.col("t"), F.array(F.lit("Known"))), t=text) == "see `Known` and Other\n```\n`Other`\n```\nx"


CHUNK = "FQN: A.B.Thing\nKind: class\nExported-As: X\nExported-As: Y\nBases:\n  - Base\nMethods:\n  - open(path: str) -> bool\n  - close() [inherited from Base]\n  - go() not implemented in this build\nProperties:\n  - size: int [readonly]\nAPI-Coverage: 3 of 4 types; 5 of 5 functions\nSource-Commit: abc1234"


def test_grammar(spark):
    s = one(spark, grammar.signature("t"), t=CHUNK)
    assert (s["bases"], len(s["methods"]), s["properties"], s["members"], len(s["limitations"])) == (["Base"], 3, ["size: int [readonly]"], [], 1)
    assert one(spark, grammar.headers("t", "Exported-As"), t=CHUNK) == ["X", "Y"]
    assert [(m["name"], m["declares"]) for m in one(spark, grammar.declared_members("t"), t=CHUNK)] == [("open", True), ("close", False), ("go", True), ("size", True)]
    assert one(spark, grammar.coverage_note("t"), t=CHUNK) == "This index holds 3 of 4 types."
    assert one(spark, grammar.coverage_note("t"), t="FQN: a") is None
    assert one(spark, grammar.suffixes("t"), t="a::b::c") == ["a::b::c", "b::c", "c"]
    example = "FQN: Example: Open\nIntro here. More.\n\nNow do it: then\nExample:\nold\nExample:\nx = 1\n\nSource-Commit: abc\n"
    assert one(spark, grammar.example_code("t"), t=example) == "x = 1"
    assert one(spark, grammar.example_code("t"), t="no marker") is None


def test_classifiers(spark):
    assert [one(spark, predicates.chunk_kind("t"), t=t) for t in ("FQN: A", "FQN: Example: a", "FQN: Doc: a", "plain")] == ["symbol", "example", "documentation", "documentation"]
    assert [one(spark, predicates.category("t"), t=t) for t in ("FQN: Doc: Setup\nx", "FQN: Doc: Any\nFAQ: x", "FQN: Doc: Known issues", "how to install it", "x")] == ["getting_started", "faq", "troubleshooting", "getting_started", "developer_guide"]
    assert one(spark, predicates.table_dominated("t"), t="| a |\n| b |\nx") and not one(spark, predicates.table_dominated("t"), t="| a |\nx\ny")
    assert one(spark, predicates.licence("t"), t="Apache License ... GNU General Public License") is None


def test_versions(spark):
    v = lambda a, b: one(spark, versions.compared(versions.parsed("a"), versions.parsed("b")), a=a, b=b)
    assert [v("v26.9", "26.9.0"), v("1.2", "1.10"), v("2.0", "1.9.9"), v("latest", "1.0")] == [0, -1, 1, None]
    assert str(one(spark, versions.indexed_at("g"), g="x__20260102T030405-ab")) == "2026-01-02 03:04:05"
    assert one(spark, versions.drift(F.lit(None).cast("int"), F.lit(0))) == "unknown"


def test_sections(spark):
    body = "intro\n# One #\ntext\n```sh\n# no heading\n```\n## Two\n# Three\nlast"
    rows = chunking.sections(spark.createDataFrame([(1, body), (2, ""), (3, "a\n\n b \n\nc"), (4, None), (5, "~~~\n# x\n```\n# y")], "doc_id int, text string")).orderBy("doc_id", "part").collect()
    got = [(r.doc_id, r.title, r.text) for r in rows]
    assert got[:4] == [(1, "", "intro"), (1, "One", "text\n```sh\n# no heading\n```"), (1, "Two", "Two"), (1, "Three", "last")]
    assert got[4:7] == [(3, "", "a"), (3, "", "b"), (3, "", "c")] and got[7][0] == 5 and len(got) == 8


def test_regrouped(spark):
    texts = ["a" * 300, "b" * 1900, "note:", "c" * 2500, "d" * 100]
    out = one(spark, chunking.regrouped(F.array(*map(F.lit, texts))))
    assert [len(x) for x in out] == [2202, 2507 + 102] and one(spark, chunking.regrouped(F.array().cast("array<string>"))) == []


def test_oversize():
    assert chunking.split_oversize("ab\ncd", 10) == ["ab\ncd"]
    parts = chunking.split_oversize("| h |\n|---|\n" + "\n".join(f"| {i:02} |" for i in range(9)), 30)
    assert all(len(p) <= 30 and p.startswith("| h |\n|---|\n| ") for p in parts) and len(parts) == 5
    assert chunking.split_oversize("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]


def test_vectors(spark):
    a, z = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, z)) == 0.0 and abs(one(spark, vectors.cosine(a, a)) - 1) < 1e-12
    with pytest.raises(ValueError, match="lengths"):
        vectors.merged_cache(spark.createDataFrame([(1, "a", [1.0]), (1, "b", [1.0, 2.0])], "file_ord int, text_sha string, vector array<double>"))


def test_bm25_counts_repeats_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "pear"), (3, None)], "doc_id int, text string")
    ask = lambda q: {r.doc_id: r.score for r in lexical.bm25(docs, spark.createDataFrame([(0, q)], "q int, t string"), "q", "t").collect()}
    single, double = ask("apple"), ask("apple apple")
    assert set(single) == {1} and abs(double[1] - 2 * single[1]) < 1e-9 and ask("zzz") == {}


def test_tiers(spark):
    tier = lambda q, n: one(spark, symbols.match_tier(F.col("q"), F.col("n")), q=q, n=n)
    name = "PdfDocument.AddWatermarkAnnotation"
    assert [tier(q, name) for q in (name.lower(), "addwatermarkannotation", "watermark", "watermark annotation", "annotation watermark", "watermar", "wa", "addw")] == [0, 1, 2, 2, None, 3, None, 3]


def test_resolution(spark):
    names = spark.createDataFrame([("a.b.C",), ("x.b.C",), ("q::D",)], "fqn string")
    asked = spark.createDataFrame([(q,) for q in ("a.b.C", "b.C", "d", "none", "C")], "query string")
    assert {r["query"]: (r["found"], r["reason"], r["fqn"]) for r in symbols.resolve(names, asked).collect()} == {"a.b.C": (True, "exact", "a.b.C"), "b.C": (False, "ambiguous", None), "d": (True, "suffix", "q::D"), "none": (False, "not_found", None), "C": (False, "ambiguous", None)}


def test_graph(spark):
    assert graph.c3({"O": [], "A": ["O"], "B": ["O"], "C": ["A", "B"]}, "C") == ["C", "A", "B", "O"]
    assert graph.c3({"A": ["B"], "B": ["A"]}, "A") == ["A", "B"] and graph.c3({"X": ["O", "A"], "A": ["O"], "O": []}, "X") == ["X", "O", "A"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "child string, parent string")
    found = {(r.child, r.ancestor): r.depth for r in graph.closure(edges).collect()}
    assert found == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2, ("d", "a"): 1, ("d", "b"): 2, ("d", "c"): 3}
    names = spark.createDataFrame([("Foo",), ("Bar",)], "name string")
    refs = spark.createDataFrame([("Foo", "Foo Bar"), ("Baz", "FooBar, Bar"), ("Q", None)], "owner string, text string")
    assert {r.name: r.score for r in graph.centrality(refs, names).collect()} == {"Foo": 0, "Bar": 2}


def test_claims(spark):
    assert one(spark, claims.anchors("t"), t="`open(x)` and `a b` `ns::T.m()`") == ["open", "ns::T.m"]
    declared = spark.createDataFrame([("A.save",), ("B.save",), ("A.open",), ("A",)], "anchor string")
    asked = spark.createDataFrame([("A",), ("open",), ("save",), ("zz",)], "anchor string")
    assert {r.anchor: r.verdict for r in claims.resolved(asked, declared).collect()} == {"A": "supported", "open": "supported", "save": "partially_supported", "zz": "unsupported"}
    assert one(spark, claims.support_clauses("t", ("pdf", "docx")), t="It reads PDF. It does not write DOCX; saves docx") == ["It reads PDF", "saves docx"]


def test_budget():
    assert budget.equal_share([10, 20, 300], 100) == 70 and budget.equal_share([1, 2], 100) == 2 and budget.equal_share([], 5) == 0


def test_excerpt(spark):
    lines = spark.createDataFrame([(1, i, 10, [f"t{i % 3}"]) for i in range(6)], "k int, line int, size int, terms array<string>")
    assert [tuple(r) for r in budget.best_excerpt(lines, "k", "line", "size", "terms", 30).collect()] == [(1, 0, 2, 3)]


def test_retrieval_quality(spark):
    rows = quality.retrieval_quality(spark.createDataFrame([("a", 1), ("a", None), ("b", 0), ("b", 2)], "f string, r int"), "f", "r").collect()
    assert {r.f: (r.n, r.hit_at_k, r.mrr, r.wrong_rate) for r in rows} == {"a": (2, 0.5, 0.5, 0.0), "b": (2, 0.5, 0.25, 0.5), "ALL": (4, 0.5, 0.375, 0.25)}


def test_python_surface(spark, tmp_path):
    (tmp_path / "m.py").write_text('__all__ = ["F", "g"]\nclass F:\n    """Doc.\n\n    More."""\n    def run(self):\n        raise NotImplementedError\n    def _no(self): ...\ndef g(): return 1\ndef h(): pass\n')
    (tmp_path / "bad.py").write_text("def (")
    rows = {(r.name, r.kind, r.owner, r.stub) for r in readers.python_surface(readers.source_files(spark, str(tmp_path), "*.py")).collect()}
    assert rows == {("F", "class", None, False), ("run", "method", "F", True), ("g", "function", None, False), ("", "parse_error", None, False)}
    assert surface.python_symbols("import enum\nclass E(enum.Enum):\n    A = 1")[1][:3] == ("A", "member", "E")


def test_manifests(spark):
    files = [("python", '[project]\nname = "a"\nversion = "1"\nlicense = {text = "MIT"}\nrequires-python = ">=3.9"'), ("js", '{"name": "b", "version": "2.0.0"}'), ("go", "module x.y/z\n\ngo 1.21"), ("rust", "not toml ["), ("dotnet", "<PackageId>N</PackageId><TargetFramework>net8.0</TargetFramework>")]
    rows = readers.manifests(spark.createDataFrame(files, "kind string, text string")).collect()
    assert [tuple(r.manifest) for r in rows] == [("a", "1", "MIT", ">=3.9"), ("b", "2.0.0", "", ""), ("x.y/z", "", "", "1.21"), ("", "", "", ""), ("N", "", "", "net8.0")]


def test_readers(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"chunks": [{"section_title": "a", "text": "x"}, {"section_title": "b", "text": "y"}]}))
    assert [(r.ord, r.text) for r in readers.chunk_files(spark, f"{tmp_path}/c.json").collect()] == [(0, "x"), (1, "y")]
    (tmp_path / "log.jsonl").write_text('{"ts": "2", "event": "published"}\nnot json\n{"ts": "1", "event": "refused"}\n')
    assert [r.ts for r in readers.publish_log(spark, f"{tmp_path}/log.jsonl").collect()] == ["1", "2"]
    assert one(spark, readers.front_matter("t"), t="---\ntitle: 'A'\n---\nbody")["body"] == "body"
    assert one(spark, readers.simple_yaml("t"), t="title: 'A b'\nx: 1\n  y: 2") == {"title": "A b", "x": "1"}


def chunk_rows(n=6):
    return [(f"c{i}", i, CHUNK.replace("Thing", f"Thing{i}")) for i in range(n)] + [("d1", 90, "FQN: Doc: Setup\nInstall the parser with the tool."), ("d2", 91, "FQN: Doc: Streams\nRead a stream of events from a socket."), ("e1", 92, "FQN: Example: Open a stream\nKind: verified_example\nRuntime-Status: ran\nExample:\nopen_stream('x')\n")]


CHUNKS = "chunk_id string, ord int, text string"


def test_store(spark, tmp_path):
    store, scope = publish.Store(spark, str(tmp_path)), publish.Scope("fam", "py", "docs")
    frame = lambda n: spark.createDataFrame(chunk_rows(n), CHUNKS)
    first = store.publish(scope, "v1", frame(6))
    assert store.active(scope) == first and store.read(scope).count() == 9
    assert store.write(scope, "v1", frame(6)) == first
    with pytest.raises(publish.Conflict):
        store.write(scope, "v1", frame(5))
    with pytest.raises(publish.Refused, match="symbols fell from 6 to 3"):
        store.publish(scope, "v2", frame(3))
    second = store.publish(scope, "v2", frame(3), accepted=("symbols:6->3",))
    old = store.lease(scope)
    store.lease(scope)
    with pytest.raises(publish.Conflict, match="lease"):
        store.activate(scope, first, second, old)
    assert store.rollback(scope) == first and store.prune(scope, keep=0) == [second]
    events = [r.event for r in readers.publish_log(spark, f"{tmp_path}/{scope.folder}/publish_log").collect()]
    assert sorted(events) == ["published", "published", "refused", "rolled_back"]
    with pytest.raises(ValueError, match="component"):
        publish.Scope("..", "a", "b")


def test_tools(spark):
    e = tools.Engine(spark, "fam", "py", spark.createDataFrame(chunk_rows(), CHUNKS).cache())
    assert {r.chunk_id for r in e.search_docs("install the parser").collect()} == {"d1"}
    assert e.search_docs("zebra quantum").first().reason == "nothing_relevant" and e.search_docs("?").first().reason == "too_little_evidence"
    rows = e.search_symbols("Thing2").collect()
    assert rows[0].fqn == "A.B.Thing2" and rows[0].tier == 1
    page = e.search_symbols("open", 2, 2).collect()
    assert len(page) == 2 and page[0].total_matches == 6 and page[0].next_offset == 4
    assert e.search_symbols("open", 2, 50).first().reason == "past_the_end"
    assert e.search_symbols("A.B.Thimg2").first().suggestions[0].startswith("A.B.Thing")
    assert e.get_symbol("Thing3").first().fqn == "A.B.Thing3" and e.get_symbol("Thing3.open").first().found
    assert e.get_symbol("Thing3.nope").first().reason == "not_found"
    assert [r.name for r in e.list_members("Thing1").collect()] == ["open", "close", "go", "size"]
    assert e.find_examples("open a stream").first().basis == "title" and e.find_examples("stream open").first().basis == "words"
    assert e.find_examples("stream open").first().confidence == "confident"
    task = e.search_symbols("closing a size").collect()
    assert [(r.fqn, r.tier) for r in task][:1] == [("A.B.Thing0", 5)]
    assert {r.chunk_id for r in e.search_docs("installation guide").collect()} == {"d1"} and e.search_docs("installation guide").first().match_quality == "category"
    assert len(e._indexes) == 3
    assert {r.kind for r in e.lookup("read a stream of events").collect()} >= {"documentation"}
    assert e.lookup("Thing4").first().name == "A.B.Thing4"
    fresh = e.report_index_freshness("abc1234ff").first()
    assert fresh.fresh and fresh.indexed_commit == "abc1234" and e.report_index_freshness().first().fresh is None
    assert e.report_index_freshness(ahead=0, behind=2).first().fresh is False
    assert e.get_product_reference("install", {}).first().reason == "not_available"
    releases = spark.createDataFrame([("v1.0", "x", None, 0), ("v1.2", "Fixed `a`", "abc1234", 1), ("nightly", "", None, 2)], "tag_name string, body string, target_commitish string, ord int")
    assert [(r.tag_name, r.richness, r.in_index) for r in e.list_recent_changes(releases, "abc1234", "1.1").collect()] == [("v1.2", "detailed", True), ("v1.0", "templated", True), ("nightly", "none", None)]
    for bad in (lambda: e.search_docs(""), lambda: e.search_docs("a", top_k=0), lambda: e.search_docs("a\x01"), lambda: e.search_docs("a b", "x"), lambda: e.report_index_freshness("xyz")):
        with pytest.raises(ValueError):
            bad()


def test_verified_examples(spark):
    kind, marker = "Kind: verified_example", "Example:"
    lines = [["FQN: Example: a", kind, marker, "x"], ["FQN: Example: a", marker, "x"], ["FQN: Example: a", kind, "Example: x"], ["FQN: a.B", kind, marker], ["FQN: Example: a", kind, "Provenance: authored", marker], ["FQN: Example: a", kind, "Provenance: authored", "Verification: passed", marker], [" " + kind], [""]]
    df = spark.createDataFrame([(i, "\n".join(x)) for i, x in enumerate(lines)] + [(99, None)], "i int, t string")
    assert sorted(r.i for r in df.where(predicates.verified_example("t")).collect()) == [0, 5]


def test_streams(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = lambda: telemetry.stream(spark, SF, schema, "events.parquet")
    table = telemetry.run_available(telemetry.windowed(events(), "1 hour"), "w", f"{tmp_path}/w", "complete")
    assert table.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    opened = telemetry.run_available(telemetry.breaker_states(events(), failures=2, open_for=86_400.0), "b", f"{tmp_path}/b")
    batch = telemetry.breaker_states(spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")), failures=2, open_for=86_400.0)
    assert opened.count() == batch.count() > 0
