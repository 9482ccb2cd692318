"""Queries and rules against plain versions of them, on small fixtures; cases with their stated outcomes."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import predicates, versions
from lodestrata.functions.binding import let
from lodestrata.operators import chunking, graph, index, lexical, vectors
from lodestrata.plans import catalog_text, catalog_tables

from .conftest import SF


def one(spark, column, **values):
    names = list(values)
    kinds = ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'long' if isinstance(values[n], int) else 'string'}" for n in names)
    return spark.createDataFrame([tuple(values[n] for n in names)], kinds).select(column.alias("x")).first()["x"]


def plain_fenced(lines):
    out, mark, size = [], "", 0
    for line in lines:
        opens = re.match(r"[ \t]{0,3}(`{3,}|~{3,})", line)
        bare = line.strip(" ")
        if size:
            out.append(True)
            if len(bare) >= size and set(bare) == {mark}:
                size = 0
        elif opens:
            mark, size = opens[1][0], len(opens[1])
            out.append(True)
        else:
            out.append(False)
    return out


def plain_sections(text):
    body = re.sub(r"\r\n?", "\n", text).strip(" ")
    body = re.sub(r"\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", body)
    lines = body.split("\n")
    inside = plain_fenced(lines)
    heads = [(i, m[2]) for i, line in enumerate(lines) if not inside[i] and (m := re.match(r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", line))]
    clean = lambda x: re.sub(r"\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", x)
    if not heads:
        return [("", p) for p in map(clean, re.split(r"\n[ \t\n\x0b\f\r]*\n+", body)) if p]
    out = [("", first)] if (first := clean("\n".join(lines[: heads[0][0]]))) else []
    for k, (i, title) in enumerate(heads):
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        out.append((title, clean("\n".join(lines[i + 1 : end])) or title))
    return out


def test_sections_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(i, t) for i, t in enumerate(["", "a\n\nb\n\n\nc", "```\n# x\n", "# A\n# B\ntext\n~~~~\n# C\n~~~\n~~~~\n## D ##", "p\n#no\n# yes"])]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (catalog_text.with_headings(docs), extra):
        found = {}
        for r in chunking.sections(df).collect():
            found.setdefault(r.doc_id, []).append((r.part, r.title, r.text))
        for r in df.collect():
            assert [x[1:] for x in sorted(found.get(r.doc_id, []))] == plain_sections(r.text), r


def test_richness_cases(spark):
    for note, verdict in catalog_tables.NOTES:
        assert one(spark, versions.richness("t"), t=note.replace("{}", "Foo")) == verdict, note
    generated = "## What's Changed\n* Add Foo by @dev-a in https://github.com/x/y/pull/7\n\n## New Contributors\n* @dev-a made their first contribution in https://x/7\n\n**Full Changelog**: https://x"
    assert one(spark, versions.richness("t"), t=generated) == "templated"
    for body in ("Regressed `Foo.bar`", "Reproduces 1,234 cases", "Synchronized `a`"):
        assert one(spark, versions.richness("t"), t=body) == "detailed"


def test_drift_and_negotiation(spark):
    drift = lambda a, b: one(spark, versions.drift(F.col("a"), F.col("b")), a=a, b=b)
    assert [drift(-1, 0), drift(0, -3), drift(0, 0), drift(2, 0), drift(0, 2), drift(1, 1)] == ["unknown", "unknown", "in_sync", "index_ahead_of_package", "package_ahead_of_index", "diverged"]
    ask = lambda r: tuple(one(spark, versions.negotiated(F.col("r"), F.col("s")), r=r, s=["2025-06-18", "2024-11-05", " 2025-03-26 "]))
    assert ask("2025-03-26") == ("2025-03-26", "none", None) and ask("2025-04-01") == ("2025-03-26", "unknown_revision", None)
    assert ask("2020-01-01") == ("2024-11-05", "below_min_supported", None) and ask(" ") == (None, None, "missing") and ask("latest") == (None, None, "malformed")


def test_categories_titles_and_licences(spark):
    category = lambda t: one(spark, predicates.category("t"), t=t)
    titled = {"Environment Setup": "getting_started", "Page Setup and Print Configuration": "developer_guide", "Unsupported features": "troubleshooting", "Common problems": "troubleshooting", "Exceptions": "developer_guide", "Dependencies": "getting_started"}
    assert {t: category(f"FQN: Doc: {t}\nx") for t in titled} == titled
    assert category("FQN: Doc: Errors\nFAQ: why?") == "faq"
    said = {"the quickstart": "getting_started", "see prerequisites": "getting_started", "a common error": "troubleshooting", "debugging it": "troubleshooting", "a workaround": "developer_guide", "our faq": "faq", "faq and installation": "getting_started"}
    assert {t: category(t) for t in said} == said
    generic = {"Quick Start (2)": True, "Additional Examples (part 3)": True, "MORE EXAMPLES": True, "Overview": False, "Quick Start for PDF": False, "Installation, Dependencies, and Quick Start": True}
    assert {t: one(spark, predicates.generic_title("t"), t=t) for t in generic} == generic
    question = {"a.b.c": False, "how": True, "Could, you": True, "add watermark": False, "add a watermark": True, "shall": True, "": False, "(what)": True}
    assert {t: one(spark, predicates.task_question("t"), t=t) for t in question} == question
    mit, bsd = "\n\n".join(predicates.MIT).upper(), predicates.BSD.replace(" ", "\n ")
    assert [one(spark, predicates.licence("t"), t=t) for t in (mit, predicates.MIT[0], "Apache License\nVersion 2.0, January 2004", bsd, bsd + " Neither the name of X", mit + bsd, "GNU General Public License")] == ["MIT", None, "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", None, None]


def test_c3_is_pythons_order_where_there_is_one():
    draw = random.Random(5)
    for _ in range(200):
        bases, made = {}, {}
        for i in range(draw.randint(1, 9)):
            own = draw.sample(list(made), draw.randint(0, min(3, len(made))))
            try:
                made[f"C{i}"] = type(f"C{i}", tuple(made[b] for b in own), {})
            except TypeError:
                continue
            bases[f"C{i}"] = own
        for name, kind in made.items():
            assert graph.c3(bases, name) == [x.__name__ for x in kind.__mro__[:-1]]
    assert sorted(graph.c3({"A": ["B"], "B": ["A"]}, "A")) == ["A", "B"]
    assert graph.c3({"X": ["O", "A"], "A": ["O"], "O": []}, "X") == ["X", "O", "A"]
    diamonds = {f"N{i}": [f"L{i}", f"R{i}"] for i in range(60)} | {f"{s}{i}": [f"N{i + 1}"] for i in range(60) for s in "LR"}
    assert len(graph.c3(diamonds, "N0")) == 181


def test_closure_is_a_walk(spark):
    draw = random.Random(6)
    edges = [(f"n{draw.randint(0, 40)}", f"n{draw.randint(0, 40)}") for _ in range(60)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    want = set()
    for a in near:
        seen, front = {a}, {a}
        for depth in range(1, 5):
            front = {y for x in front for y in near.get(x, ()) if y not in seen}
            seen |= front
            want |= {(a, y, depth) for y in front}
    found = graph.closure(spark.createDataFrame(edges, "child string, parent string"), hops=4)
    assert sorted(map(tuple, found.select("child", "ancestor", "depth").collect())) == sorted(want)


def test_hash_embedding_counts_buckets(spark):
    import hashlib
    import math

    words = ["a", "b", "a", "c" * 40]
    want = Counter(int(hashlib.sha256(w.encode()).hexdigest()[:16], 16) % 64 for w in words)
    found = one(spark, vectors.hash_embedding(F.col("t")), t=words)
    assert {i: x for i, x in enumerate(found) if x} == pytest.approx({i: n / math.sqrt(sum(m * m for m in want.values())) for i, n in want.items()})
    assert one(spark, let(F.size("t"), lambda n: n * n + n), t=words) == 20


def test_index_is_the_scan(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = spark.createDataFrame([(1, "of hand reheat hand"), (2, "the onation ring"), (3, "")], "q int, text string")
    rows = lambda df, *by: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*by).collect())
    built = index.build(docs, str(tmp_path / "full"), buckets=5)
    assert rows(built.bm25(asked, "q", "text"), "q", "doc_id", "score") == rows(lexical.bm25(docs, asked, "q", "text"), "q", "doc_id", "score")
    plain = index.build(docs, str(tmp_path / "plain"), tokeniser="plain", buckets=3)
    assert rows(plain.tf_idf(asked, "q", "text"), "q", "doc_id", "score") == rows(lexical.tf_idf(docs, asked, "q", "text"), "q", "doc_id", "score")
    terms = spark.createDataFrame([(1, "hand"), (1, "onation"), (2, "nowhere")], "q int, term string")
    weighted = lexical.weighted_terms(docs, terms)
    assert rows(built.weights(terms), "q", "term", "weight") == rows(weighted, "q", "term", "weight")
    covered = lexical.coverage(docs, weighted, "q")
    assert rows(built.coverage(weighted, "q"), "q", "doc_id", "coverage", "n_present") == rows(covered, "q", "doc_id", "coverage", "n_present")
    assert rows(built.guarded(covered, terms, "q"), "q", "doc_id", "coverage") == rows(lexical.guarded(covered, docs, terms, "q"), "q", "doc_id", "coverage")
    assert rows(built.ubiquitous(), "stem", "df") == rows(lexical.ubiquitous(lexical.postings(docs), docs.count()), "stem", "df")
    assert rows(built.stats, "n_docs", "avgdl") == rows(lexical.corpus_stats(docs), "n_docs", "avgdl")
    none = index.build(docs.where("false"), str(tmp_path / "none"))
    assert none.bm25(asked, "q", "text").count() == 0


def test_a_query_reads_its_tokens_files_only(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    built = index.build(docs, str(tmp_path / "i"), buckets=32)
    asked = spark.createDataFrame([(1, "hand reheat")], "q int, text string")
    words = index.Words.of(built.asked(asked, "q", "text"))
    for table in (built.postings, built.dictionary):
        own = built.of_tokens(table, words)
        files = lambda df: {r[0] for r in df.select("_metadata.file_path").distinct().collect()}
        assert 0 < len(own.select("bucket").distinct().collect()) <= 2 and files(own) < files(table)
        plan = own._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [bucket#" in plan and " IN (" in plan.split("PartitionFilters")[1] and "In(token, [hand,reheat])" in plan
    scans = built.bm25(asked, "q", "text")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in scans and "In(token, [hand,reheat])" in scans


def test_more_words_than_filters_hold_are_joined(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    built = index.build(docs, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "of hand reheat hand"), (2, "the onation ring")], "q int, text string")
    terms = spark.createDataFrame([(1, "hand", 0.5), (1, "onation", 1.0), (2, "hand", 0.75)], "q int, term string, weight double")
    rows = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())
    want = [rows(built.bm25(asked, "q", "text")), rows(built.coverage(terms, "q")), rows(built.holders(terms)), rows(built.weights(terms.select("q", "term")))]
    for name, most in (("MOST_ASKED", 1), ("MOST_ROWS", 1)):
        monkeypatch.setattr(index, name, most)
        assert [rows(built.bm25(asked, "q", "text")), rows(built.coverage(terms, "q")), rows(built.holders(terms)), rows(built.weights(terms.select("q", "term")))] == want


def test_an_index_is_built_once_a_generation(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    docs.write.parquet(str(tmp_path / "docs"))
    held = spark.read.parquet(str(tmp_path / "docs"))
    first, again = index.of_generation(held), index.of_generation(held)
    assert first.postings.inputFiles() == again.postings.inputFiles()
    docs.limit(10).write.mode("overwrite").parquet(str(tmp_path / "docs"))
    other = index.of_generation(spark.read.parquet(str(tmp_path / "docs")))
    assert other.postings.inputFiles() != first.postings.inputFiles() and other.stats.first()["n_docs"] == 10


def test_readiness(spark):
    from lodestrata.plans import operations

    symbol = lambda i, c="abc1234": ("a", f"s{i}", f"FQN: x.S{i}\nKind: class\nSource-Commit: {c}")
    rows = [*(symbol(i) for i in range(3)), ("a", "d", "FQN: Doc: y\nz"), ("b", "d", "text"), *(("c", f"s{i}", symbol(i, f"abc123{i % 2}")[2]) for i in range(4)), ("c", "d", "FQN: Doc: y\nz"), ("c", "e", "FQN: Example: run"), ("d", "", "x"), ("d", "k", None)]
    found = {r.g: r for r in operations.readiness(spark.createDataFrame(rows, "g string, chunk_id string, text string"), ["g"]).collect()}
    assert (found["a"].ready, found["a"].reasons, found["a"].warnings, found["a"].symbols, found["a"].docs) == (True, [], ["no verified examples"], 3, 1)
    assert (found["b"].ready, found["b"].reasons) == (False, ["symbols 0 below the floor 3"])
    assert (found["c"].ready, found["c"].warnings, found["c"].examples) == (True, ["generation mixes 2 source commits"], 1)
    assert (found["d"].ready, found["d"].reasons) == (False, ["2 documents are malformed (chunk_id, text)"])


def plain_rate(times, interval, burst):
    start, sent, held, out = None, 0, 0, []
    for t in sorted(times):
        carried = 0
        if start is None or t - start >= interval:
            start, sent, carried, held = t, 0, held, 0
        if sent >= burst:
            held += 1
            continue
        sent += 1
        out.append((t, carried))
    return out


def test_rate_limited_log(spark):
    from lodestrata.plans import operations

    draw = random.Random(9)
    events = {k: [round(draw.uniform(0, 60), 3) for _ in range(n)] for k, n in (("a", 60), ("b", 4), ("c", 25))}
    rows = spark.createDataFrame([(k, t, "m") for k, ts in events.items() for t in ts], "k string, at double, message string")
    found = {}
    for r in operations.rate_limited(rows, "k", 10.0, 5).collect():
        found.setdefault(r.k, []).append((r.at, r.suppressed))
    assert {k: sorted(v) for k, v in found.items()} == {k: plain_rate(ts, 10.0, 5) for k, ts in events.items()}


def test_watch_and_sidecar(spark, tmp_path):
    from lodestrata.plans import operations, publish
    from lodestrata.plans.shared_files import Folder

    store, scope = publish.Store(spark, str(tmp_path / "store")), publish.Scope("fam", "py", "docs")
    watch = operations.GenerationWatch(store, scope)
    assert watch.problem() is None
    generation = store.write(scope, "v1", spark.createDataFrame([("c", 1, "FQN: a.B")], "chunk_id string, ord int, text string"))
    store.activate(scope, generation, None, store.lease(scope))
    assert watch.problem() is None and watch.seen == generation
    store._folder(scope).delete("active.json")
    assert watch.problem() == "active pointer has vanished"
    sidecar = operations.Sidecar(Folder(spark, str(tmp_path / "side")), "releases.json", "x/y")
    assert not sidecar.fresh() and sidecar.etag() is None and sidecar.failed("no net") == "empty" and not sidecar.fresh()
    assert sidecar.fetched([{"tag": "v1"}], 'W/"1"', now=100.0) == "replaced" and sidecar.fresh(50, now=120.0) and not sidecar.fresh(50, now=160.0)
    assert sidecar.etag() == 'W/"1"' and operations.Sidecar(sidecar.folder, "releases.json", "other/z").etag() is None
    assert sidecar.failed("later") == "kept" and not sidecar.fresh(50, now=120.0) and sidecar.fetched(None, 'W/"1"', now=130.0) == "unchanged" and sidecar.fresh(50, now=140.0)


def test_late_events_and_a_durable_sink(spark, tmp_path):
    """Windows close with the watermark; events later than that are dropped; a second run adds nothing again."""
    import datetime

    from lodestrata.streaming import telemetry

    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    schema = "ts timestamp, event_type string, value double"
    for i, rows in enumerate([[(at(1), "a", 1.0), (at(2), "a", 2.0)], [(at(50), "a", 4.0)], [(at(51), "b", 2.0)], [(at(3), "a", 8.0), (at(51), "b", 16.0)], [(at(59), "c", 32.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{i}"))
    stream = lambda: telemetry.windowed(telemetry.stream(spark, str(tmp_path / "in" / "*"), schema), "10 minutes", late="5 minutes")
    for _ in range(2):
        out = telemetry.run_to_table(stream(), str(tmp_path / "out"), str(tmp_path / "check"))
        assert [(r.event_type, r.n, r.total) for r in out.collect() if r.start.minute == 0] == [("a", 2, 3.0)]


def test_suggestions_are_the_sequence_matchers(spark):
    import difflib

    from lodestrata.operators import symbols

    draw = random.Random(3)
    names = sorted({"".join(draw.choices("abAB", k=draw.randint(2, 7))) for _ in range(300)})
    asked = ["abab", "BBA", "zzzz", "", "aabbaab"]
    folded = {x.casefold(): x for x in reversed(names)}
    want = {q: [folded[x] for x in difflib.get_close_matches(q.casefold(), list(folded), 5, 0.6)] if q else [] for q in asked}
    df = spark.createDataFrame([(n,) for n in names], "fqn string").repartition(4)
    found = {r.query: r.suggestions for r in symbols.suggestions(spark.createDataFrame([(q,) for q in asked], "query string"), df).collect()}
    assert found == want


def test_page_candidates(spark):
    from lodestrata.operators import pages

    long = "It cannot do this. " * 12
    body = f"Intro.\n## What is not supported\n{long}\n### Details\nmore\n## Usage\n```\n## Installation\n```\n## Installation\n{long}"
    carve = lambda t, b: [tuple(x) for x in spark.createDataFrame([(t, b)], "t string, b string").select(pages.carved(F.col("t"), F.col("b")).alias("x")).first()[0]]
    assert carve("Guide", body) == [("Guide", "Intro.\n## Usage\n```\n## Installation\n```"), ("Scope and Limitations: What is not supported", f"{long}\n**Details**\nmore"), ("Installation", long)]
    assert carve("Limitations", body)[1:] == [("Installation", long)] and carve("x", "no heading") == [("x", "no heading")]
    assert carve("Guide", "## Known issues\nshort") == [("Guide", "## Known issues\nshort")]
    side = "struct<title_left:string,content_left:string,title_right:string,content_right:string>"
    schema = f"page string, overview struct<enable:boolean,title:string,content:string>, content struct<enable:boolean,block:array<{side}>>, faq struct<enable:boolean,list:array<struct<question:string,answer:string>>>"
    rows = [("p", (True, "About", "text"), (True, [("Guide", body, None, "lost"), ("L", "l", "R", "r")]), (True, [("Why?", "So."), (None, "x")])), ("q", (False, "a", "b"), None, None), ("r", None, (True, None), (True, None))]
    found = [(r.place, r.origin, r.title, r.body) for r in pages.doc_sections(spark.createDataFrame(rows, schema)).orderBy("page", "place").collect()]
    assert [x[:3] for x in found] == [(0, "overview", "About"), (1, "content", "Guide"), (2, "content", "Scope and Limitations: What is not supported"), (3, "content", "Installation"), (4, "content", "L"), (5, "content", "R"), (6, "faq", "Why?")]
    assert found[-1][3] == "FAQ: Why?\n\nSo."


def test_titles_from_descriptions(spark):
    from lodestrata.operators import pages

    assert pages.derived_title("# Intro\n\nOpen a workbook\nand save it. Then more.") == "Open a workbook and save it"
    assert [pages.derived_title(t) for t in ("", "Usage:", "An Example: x", "w " * 21)] == ["", "", "", ""]
    rows = [("a", 0, "Quick Start", "One."), ("a", 1, "Quick Start (2)", "Save a file:"), ("a", 2, "Usage (part 3)", "Save a file."), ("a", 3, "Examples (4)", ""), ("a", 4, "Tables (2)", "Other."), ("a", 5, "Save a file (2)", "x")]
    found = pages.retitled(spark.createDataFrame(rows, "pilot string, ord int, title string, description string"), "pilot").orderBy("ord").collect()
    assert [r.title for r in found] == ["Quick Start", "Save a file", "Save a file (3)", "Examples (4)", "Tables (2)", "Save a file (2)"]


def test_readme_sections(spark):
    from lodestrata.operators import pages

    doc = lambda title, body, *tail: "\n".join([f"FQN: Doc: {title}", body, *tail])
    texts = [
        doc("Known Limitations", f"{pages.LEAD_IN}\nof this.\n\nsecond", "Part: 2 of 2", "Source-Commit: abc1234"), doc("Known Limitations", "first", "Part: 1 of 2"), doc("Other limitations", "third"),
        doc("Limitations FAQ", "FAQ: why?\n\nno"), doc("Installation", "pip install x"), doc("How to install", "FAQ: how?\n\nbuild it"), doc("install?", "FAQ: bare"), "FQN: a.Install\nx",
    ]
    chunks = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "scope string, ord int, text string")
    read = lambda section: pages.readme_section(chunks, ["scope"], section).first()
    r = read("limitations")
    assert (r.title, r.text, r.commit, r.ordered, r.parts, r.all_faq) == ("Known Limitations; Other limitations", "first\n\nsecond\n\nthird", "abc1234", True, 3, False)
    r = read("install")
    assert (r.title, r.text, r.commit, r.parts, r.all_faq) == ("Installation; How to install", "pip install x\n\nbuild it", None, 2, False)
    assert read("capabilities") is None


def test_minimums(spark):
    from lodestrata.plans import reference

    own = lambda kind, v: one(spark, reference.manifest_minimum(kind, F.col("v")), v=v)
    assert [own("python", ">=3.10,<3.13"), own("java", "1.8"), own("java", "17"), own("dotnet", "net10.0;net8.0"), own("dotnet", "netstandard"), own("go", "")] == ["3.10", "8", "17", "8", None, None]
    said = lambda kind, t: one(spark, reference.text_minimum(kind, F.col("t")), t=t)
    assert [said("java", "Java 1.8 or later"), said("js", "Node.js 18 or later"), said("cpp", "CMake 3.20"), said("rust", "none")] == ["8", "18", "3.20", None]
    assert [one(spark, reference.minimums_agree(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("1.24", "1.24.5"), ("1.2", "1.24"), ("3", "3"))] == [True, False, True]


def test_errors_that_clients_may_read():
    from lodestrata.plans import reference

    kept = []
    safe = [ValueError("the query is empty")]
    unsafe = [KeyError("text"), TypeError("x"), ValueError("a\nb"), ValueError("x" * 301), OSError("no file /usr/lib/x"), OSError(r"C:\temp\x"), ValueError("in site-packages"), ValueError("<A object at 0x7f>")]
    assert [reference.public_error(e, "failed") for e in safe] == ["the query is empty"]
    assert [reference.public_error(e, "failed", kept.append) for e in unsafe] == ["failed"] * len(unsafe) and len(kept) == len(unsafe)


def test_tool_schemas():
    from lodestrata.plans import reference, tools

    schema = reference.tool_schema(tools.Engine.search_docs)
    assert schema == {"type": "object", "properties": {"query": {"type": "string"}, "content_type": {"type": "string"}, "top_k": {"type": "integer", "default": 10}}, "additionalProperties": False, "required": ["query"]}
    for name in ("lookup", "search_symbols", "get_symbol", "list_members", "find_examples", "get_product_reference", "list_recent_changes", "report_index_freshness"):
        assert set(reference.tool_schema(getattr(tools.Engine, name))) >= {"type", "properties"}


def test_parts_of_a_text():
    import json

    from lodestrata.plans import reference

    draw = random.Random(2)
    for _ in range(200):
        text = "".join(draw.choice(["word ", "é\n", "\n", "```\n", '"quoted"\n', "x" * draw.randint(1, 60)]) for _ in range(draw.randint(1, 40)))
        lines = text.split("\n")
        inside = [a and b for a, b in zip(plain_fenced(lines), [*plain_fenced(lines)[1:], False], strict=True)]
        at, pieces = 0, []
        while at is not None and at < len(text):
            piece, after = reference.part_from(text, at, inside, 40)
            assert piece and len(json.dumps(piece).encode()) - 2 <= 40 and (after is None or after == at + len(piece))
            assert after is None or piece.endswith("\n") or len(json.dumps(text[at:].split("\n")[0]).encode()) - 2 > 38
            pieces.append(piece)
            at = after
        assert "".join(pieces) == text
    with pytest.raises(ValueError, match="offset"):
        reference.part_from("abc", 3, [False])


def test_enum_members():
    from lodestrata.operators import surface

    source = "class A(Enum):\n    X = 1\n    Y = 'png'\n    Z = auto()\n    W = make()\n    _v = 2\n    a, b = 1, 2\n    T: int = 3\nclass B: pass\nclass B: pass\n"
    assert surface.enum_members(source, "A") == [("X", "1"), ("Y", "'png'"), ("Z", "auto()"), ("W", "")]
    assert surface.enum_members(source, "B") is None and surface.enum_members(source, "B", 10) == [] and surface.enum_members("class (", "A") is None
