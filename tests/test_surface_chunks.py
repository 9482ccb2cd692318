"""Symbol chunks of a nested surface, and the index of what prose may cite."""

from __future__ import annotations

import json
from pathlib import Path

from lodestrata.functions import grammar
from lodestrata.operators import graph, surface_chunks
from lodestrata.sources import readers

METHODS = [
    {"name": "open", "params": [{"name": "path", "type": ": str", "kind": "positional_only"}, {"name": "mode", "default": "'r'"}, {"name": "x", "kind": "keyword_only", "optional": True}, {"name": "", "type": "const T&"}], "return_type": "bool", "modifiers": ["static", "async"], "doc": "Opens  it."},
    {"name": "open2", "params": [{"name": "*a", "kind": "var_positional"}, {"name": "b", "kind": "keyword_only"}], "receiver": "&self", "throws": ["E1", "E2"], "generics": "<T>", "where": "T: X", "deprecated": True, "deprecated_reason": "use\nopen"},
    {"name": "__init__", "inherited_from": "Base"},
    {"name": "Base", "inherited_from": "a.Base"},
    {"name": "close", "inherited_from": "a.Base"},
    {"name": "close", "inherited_from": "a.Base"},
    {"name": "m", "mixin": "Mix", "file": "x\\y.js", "promoted_from": "Q", "stub": True, "stub_reason": "throws"},
]
TYPES = [
    {"name": "Doc", "kind": "class", "class_import": "pkg.Doc", "file": "pkg/__init__.py", "line": 1},
    {"name": "Doc", "kind": "class", "class_import": "pkg.core.Doc", "file": "pkg/core.py", "line": 2, "doc": "A doc.", "bases": ["Base"], "methods": METHODS, "canonical_namespace": "pkg.core",
     "properties": [{"name": "n", "type": "int", "writable": False}, {"name": "n", "type": "str"}, {"name": "m", "access_mode": "readwrite", "value": "5"}], "deprecated": True, "deprecated_reason": "old"},
    {"name": "T", "kind": "class", "file": "tests/test_x.py", "methods": [{"name": "t"}]},
    {"name": "Mode", "kind": "enum", "file": "a/one.cs", "line": 7, "enum_members": [{"name": "A", "value": "1"}, {"name": "B", "payload": "{ x }", "stub": True}, {"name": "C", "payload": "(f64)"}]},
    {"name": "Mode", "kind": "enum", "file": "a/one.cs", "line": 7},
    {"name": "Mode", "kind": "enum", "file": "b/two.cs", "canonical_namespace": "B"},
    {"name": "run", "kind": "function", "class_import": "pkg.run", "params": [{"name": "n", "type": "int"}], "return_type": "str", "stub": True},
    {"name": "MAX", "kind": "constant", "type": "int", "value": "5"},
    {"name": "GO", "kind": "variable", "package": "ai", "import_path": "x/ai", "type": "T", "value": "7"},
    {"name": "Alias", "kind": "class", "class_import": "q.Alias", "reexport_of": "r.Alias", "shadows": "z.Alias"},
    {"name": "Alias", "kind": "class", "class_import": "r.Alias", "reexport_of": "s.Alias"},
    {"name": "Alias", "kind": "class", "class_import": "s.Alias", "alias_of": "X | Y", "generics": "<T>", "derives": ["D", "E"], "underlying": "u  v"},
    {"name": "L1", "kind": "class", "class_import": "l.A", "reexport_of": "l.B"},
    {"name": "L2", "kind": "class", "class_import": "l.B", "reexport_of": "l.A"},
]


def surface(spark, tmp_path: Path, types=TYPES):
    path = tmp_path / "surface.json"
    path.write_text(json.dumps({"source_repository": "r", "source_commit": "c", "language": "python", "types": types}))
    return readers.api_surface(spark, str(path))


def test_a_nested_surface_becomes_chunks(spark, tmp_path):
    rows = surface_chunks.symbol_chunks(surface(spark, tmp_path)).orderBy("ord").collect()
    text = {r.fqn: r.text for r in rows}
    cover = "\n\nAPI-Coverage: 7 of 7 types; 2 of 2 constants/variables; 1 of 1 functions"
    assert [r.fqn for r in rows] == ["pkg.Doc", "pkg.core.Doc", "one.Mode@7", "one.Mode@7#2", "B.Mode", "pkg.run", "MAX", "GO", "q.Alias", "r.Alias", "s.Alias", "l.A", "l.B"]
    assert text["pkg.Doc"] == "FQN: pkg.Doc\nKind: class\nDefined-In: pkg.core.Doc" + cover
    assert text["pkg.core.Doc"] == (
        "FQN: pkg.core.Doc\nKind: class\nDeprecated: old\nExported-As: pkg.Doc\nA doc.\n\nBases:\n  - Base\n\nMethods:\n"
        "  - open(path: str, /, mode = 'r', *, x?, const T&) -> bool [static, async]  (Opens it.)\n"
        "  - open2(&self, *a, b) throws E1, E2  [generic <T> T: X] (deprecated: use open)\n"
        "  - close()  (inherited from a.Base)\n"
        "  - m()  (mixin Mix, x/y.js)  (promoted from Q)  (not implemented in this build: throws)\n\n"
        "Properties:\n  - n: int (read-only)\n  - m = 5 (writable)" + cover
    )
    assert rows[1].section_title == "pkg.core.Doc (deprecated: old)"
    assert text["one.Mode@7"].split("\n\n")[1] == "Members:\n  - A = 1\n  - B { x }  (not implemented in this build)\n  - C(f64)"
    assert text["pkg.run"] == "FQN: pkg.run\nKind: function\n\nMethods:\n  - run(n: int) -> str  (not implemented in this build)" + cover
    assert text["MAX"] == "FQN: MAX\nKind: constant\n\nValue: int = 5" + cover
    assert text["GO"] == "FQN: GO\nKind: variable\nPackage: ai\nImport: x/ai\nQualified: ai.GO\n\nValue: T = 7" + cover
    assert text["q.Alias"] == "FQN: q.Alias\nKind: class\nDefined-In: s.Alias\nShadows: z.Alias\nNote: this exported name is an empty placeholder at runtime; the working class is z.Alias" + cover
    assert text["s.Alias"] == "FQN: s.Alias\nKind: class\nExported-As: q.Alias\nExported-As: r.Alias\nAlias-Of: X | Y\nGenerics: <T>\nDerives: D, E\nUnderlying: u v" + cover
    assert [r.definition for r in rows if r.fqn.startswith("l.")] == [None, None]
    held = spark.createDataFrame([(text["pkg.core.Doc"],)], "text string").select(grammar.declared_members("text").alias("m")).first().m
    assert [(m.name, m.declares) for m in held] == [("open", True), ("open2", True), ("close", False), ("m", False), ("n", True), ("m", True)]


def test_slots_keep_a_definition_with_its_names(spark, tmp_path):
    rows = surface_chunks.symbol_chunks(surface(spark, tmp_path), most=2).orderBy("ord").collect()
    assert [r.fqn for r in rows] == ["pkg.Doc", "pkg.core.Doc", "Mode"]
    assert rows[0].text.endswith("API-Coverage: 2 of 7 types; 0 of 2 constants/variables; 0 of 1 functions")


def test_surfaces_with_nulls_few_fields_and_more_scopes(spark):
    few = spark.createDataFrame([("a", 0, "X", None, [("m",)]), ("b", 0, "X", "class", None), (None, 0, None, None, None), (None, 1, "", "class", [])], "scope string, ord int, name string, kind string, methods array<struct<name:string>>")
    rows = {(r.scope, r.ord): r for r in surface_chunks.symbol_chunks(few, ["scope"]).collect()}
    assert rows["a", 0].text == "FQN: X\nKind: \n\nMethods:\n  - m()\n\nAPI-Coverage: 1 of 1 types"
    assert rows["b", 0].text == "FQN: X\nKind: class\n\nAPI-Coverage: 1 of 1 types"
    assert len(rows) == 4 and len({r.fqn for k, r in rows.items() if k[0] is None}) == 2
    assert surface_chunks.symbol_chunks(few.limit(0), ["scope"]).count() == 0


def test_ends_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (103, 100), (200, 200), (201, 200)]
    found = {r.node: r.end for r in graph.chain_ends(spark.createDataFrame(links, "node int, next int")).collect()}
    assert found == {i: 40 for i in range(40)}
    assert graph.chain_ends(spark.createDataFrame([], "node int, next int")).count() == 0


def test_anchors_are_looked_up_in_their_partitions_only(spark, tmp_path):
    forms = surface_chunks.anchor_forms(surface(spark, tmp_path))
    index = surface_chunks.AnchorIndex.build(forms, str(tmp_path / "anchors"))
    cited = ["Doc", "Doc.open", "pkg.core.Doc.n", "pkg.core", "pkg", "core", "open2", "run", "Mode.A", "B.Mode", "A", "C", "t", "net8.0", "v1.2", "setup.py", "X.Foss", "Nope", None, "Doc"]
    asked = spark.createDataFrame([("r", "c", a) for a in cited], "source_repository string, source_commit string, anchor string")
    out = index.classified(asked)
    found = {r.anchor: (r.n, r["class"]) for r in out.collect()}
    assert found == {
        "Doc": (2, "symbol"), "Doc.open": (1, "symbol"), "pkg.core.Doc.n": (1, "symbol"), "pkg.core": (0, "symbol"), "pkg": (0, "symbol"), "core": (0, "unresolved"), "open2": (0, "unresolved"), "run": (1, "symbol"), "Mode.A": (1, "symbol"),
        "B.Mode": (1, "symbol"), "A": (0, "unresolved"), "C": (0, "symbol"), "t": (0, "symbol"), "net8.0": (0, "non_symbol"), "v1.2": (0, "non_symbol"), "setup.py": (0, "non_symbol"), "X.Foss": (0, "non_symbol"), "Nope": (0, "unresolved"),
    }
    one = index.of_last(asked.where("anchor = 'Nope'").withColumnRenamed("anchor", "last"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert one.count() == 0
    other = spark.createDataFrame([("other", "c", "Doc")], "source_repository string, source_commit string, anchor string")
    assert index.classified(other).first()["class"] == "unresolved"
    texts = ["`Nope` and `Nope.x(1)` ``Nope` `a b`", "```\n`Nope`\n```\n`Doc`", "", None]
    prose = spark.createDataFrame([("r", "c", i, t) for i, t in enumerate(texts)], "source_repository string, source_commit string, k int, text string")
    assert [(r.text, r.neutralised) for r in index.neutralised(prose, "k").orderBy("k").collect()] == [("Nope and Nope.x(1) `Nope `a b`", 3), (texts[1], 0), ("", 0), (None, 0)]
