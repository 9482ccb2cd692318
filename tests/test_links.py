"""Exports of modules and re-exported shells against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import relevance
from lodestrata.operators import exports, graph, symbols


def plain_names(modules, items, uses):
    """All names of all modules, by trying every use again until nothing changes."""
    names = {(m[2], m[3], "module", m[1], None, m[4]) for m in modules if m[2] is not None} | {(m, n, "item", m, n, p) for _, m, n, p in items}
    parent, root = {m[1]: m[2] for m in modules}, next(m[1] for m in modules if m[2] is None)

    def targets(module, segment):
        if segment in ("crate", "self", "super"):
            found = {"crate": root, "self": module, "super": parent.get(module)}[segment]
            return {("module", found, None)} if found is not None else set()
        return {(k, t, i) for m, n, k, t, i, _ in names if (m, n) == (module, segment)}

    while True:
        before = len(names)
        for _, module, path, bound, public in uses:
            now = {("module", module, None)}
            for segment in path:
                now = {t for kind, at, _ in now if kind == "module" for t in targets(at, segment)}
            for kind, target, item in now if path else ():
                if bound is not None:
                    names.add((module, bound, kind, target, item, public))
                elif kind == "module":
                    names |= {(module, n, k, t, i, public) for m, n, k, t, i, p in names if m == target and p}
        if len(names) == before:
            return names


def plain_surface(modules, items, uses):
    """The shortest paths, by walking all of them without a module twice."""
    names, best = plain_names(modules, items, uses), {}

    def walk(module, path, held):
        for m, n, kind, target, item, public in names:
            if m == module and public:
                own = (*path, n)
                if kind == "item":
                    best[target, item] = min(best.get((target, item), (99, ())), (len(own), own))
                elif target not in held:
                    walk(target, own, held | {target})

    root = next(m[1] for m in modules if m[2] is None)
    walk(root, (), {root})
    return {(t, i, "::".join(p)) for (t, i), (_, p) in best.items()}


def library(seed):
    draw = random.Random(seed)
    n = draw.randint(2, 9)
    modules = [("s", "0", None, "", True)] + [("s", str(i), str(draw.randrange(i)), f"m{i}", draw.random() < 0.7) for i in range(1, n)]
    items = [("s", str(draw.randrange(n)), draw.choice(["A", "B", "C", "D"]), draw.random() < 0.7) for _ in range(8)]
    word = lambda: draw.choice(["crate", "self", "super", "A", "B", "R", *(f"m{i}" for i in range(1, n))])
    uses = [("s", str(draw.randrange(n)), [word() for _ in range(draw.randint(0, 3))], draw.choice([None, None, "R", "A", "m1"]), draw.random() < 0.8) for _ in range(9)]
    return modules, items, uses


@pytest.mark.parametrize("seed", range(4))
def test_exports_are_those_of_the_walk(spark, seed):
    modules, items, uses = library(seed)
    frames = (
        spark.createDataFrame([*modules, (None, "9", "0", "m9", True), ("s", None, "0", "x", None)], "scope string, module string, parent string, name string, public boolean"),
        spark.createDataFrame([*items, ("s", "0", None, True)], "scope string, module string, name string, public boolean"),
        spark.createDataFrame([*uses, ("s", "0", None, "Z", True)], "scope string, module string, path array<string>, bound string, public boolean"),
    )
    found = {tuple(r)[1:] for r in exports.resolved_names(*frames).collect()}
    assert found == plain_names(modules, items, uses)
    assert {tuple(r)[1:] for r in exports.surface(*frames).collect()} == plain_surface(modules, items, uses)


def test_a_library_without_uses(spark):
    modules = spark.createDataFrame([("s", "0", None, "", True)], "scope string, module string, parent string, name string, public boolean")
    items = spark.createDataFrame([], "scope string, module string, name string, public boolean")
    uses = spark.createDataFrame([], "scope string, module string, path array<string>, bound string, public boolean")
    assert exports.surface(modules, items, uses).count() == exports.resolved_names(modules, items, uses).count() == 0


def test_stubs_go_with_the_only_definition(spark):
    rows = [
        (1, "Doc", "class", "a.Doc", "a/__init__.py", 0, False, False, False),  # the only one below a
        (2, "Doc", "class", "a.x.Doc", "a/x.py", 3, False, False, False),
        (3, "Doc", "class", "b.Doc", "b/__init__.py", 0, False, False, False),  # none below b; two of its name and kind
        (4, "Doc", "class", "c.Doc", "c/y.py", 2, False, False, False),
        (5, "Page", "enum", "q.Page", "q/gen.py", 0, False, False, False),  # the only one anywhere
        (6, "Page", "enum", "p.Page", "p/z.py", 1, False, False, False),
        (7, "Page", "class", "p.Page", "p/z.py", 1, False, False, False),
        (8, "Page", "enum", "p.t.Page", "p/test_z.py", 1, True, False, False),  # of a test
        (9, "Old", "class", "a.Old", "a/__init__.py", 0, False, True, False),  # replaces another
        (10, "Old", "class", "a.o.Old", "a/o.py", 5, False, False, False),
        (11, "New", "class", "a.New", "a/__init__.py", 0, False, False, False),
        (12, "New", "class", "a.n.New", "a/n.py", 5, False, False, True),  # is replaced
        (13, "Fn", "function", "a.Fn", "a/f.py", 0, False, False, False),
        (14, "Fn", "function", "b.Fn", "b/f.py", 2, False, False, False),
        (15, "Cpp", "class", "a.Cpp", "a/c.cpp", 0, False, False, False),
        (16, "Cpp", "class", "b.Cpp", "b/c.py", 2, False, False, False),
        (17, None, None, None, None, 0, None, None, None),
        (18, "Ax", "class", "ab.Ax", "ab/u.py", 2, False, False, False),
        (19, "Ax", "class", "a.Ax", "a/__init__.py", 0, False, False, False),  # ab is not below a
    ]
    entries = spark.createDataFrame(rows, "id int, name string, kind string, import_path string, file string, members int, is_test boolean, shadows boolean, shadowed boolean")
    found = lambda *more: {tuple(r) for r in graph.stub_pairs(entries, *more).collect()}
    assert found() == {(1, 2, "package"), (5, 6, "name"), (19, 18, "name")}
    known = spark.createDataFrame([(4, 2), (5, 7)], "shell int, definition int")
    assert found(known) == {(1, 2, "package"), (3, 2, "name"), (19, 18, "name")}


def test_terms_of_a_task(spark):
    queries = spark.createDataFrame([(1, "How do I merge two Workbooks' cells to disk?"), (2, "cell"), (3, "cells"), (4, "add a cell"), (5, "use the API"), (6, ""), (7, None), (8, "convert AddPDFPage2 to a sheet")], "query_id int, query string")
    pairs = spark.createDataFrame([("merge", "concat"), ("Merge", "appending"), ("merging", "append"), (None, "x"), ("sheets", "grid")], "word string, value string")
    found: dict = {}
    for r in symbols.evidence_terms(queries, "cells", pairs).orderBy("query_id", "place").collect():
        found.setdefault(r.query_id, []).append((r.concept, r.forms, r.light, r.family_stem))
    assert found[1] == [("merg", ["append", "concat", "merg"], False, False), ("two", ["two"], False, False), ("workbook", ["workbook"], False, False)]
    assert found[2] == [("cell", ["cell"], False, True)] and found[3] == [("cell", ["cell"], False, False)]
    assert found[4] == [("add", ["add"], True, False), ("cell", ["cell"], False, True)]
    assert [x[0] for x in found[5]] == ["us", "api"] or [x[0] for x in found[5]] == ["use", "api"]
    assert 6 not in found and 7 not in found
    assert [x[0] for x in found[8]] == ["convert", "addpdfpage2", "add", "pdf", "pag", "2", "sheet"]
    assert found[8][0][1:3] == (["conversion", "convert"], True) and found[8][-1][1] == ["grid", "sheet", "tab", "worksheet"]


def test_titles_are_anchored_by_synonyms_but_not_by_what_all_do(spark):
    cases = [(["export"], "Save a file", True), (["export", "deck"], "Save a file", False), (["colour", "deck"], "Color of cells", True), (["save", "deck"], "Save a file", True), (["deck"], "x", False), ([], "x", False), (list("abcde"), "x", True)]
    rows = spark.createDataFrame([(i, t, x) for i, (t, x, _) in enumerate(cases)], "i int, terms array<string>, title string")
    found = {r.i: r.a for r in rows.select("i", relevance.title_anchored(F.col("terms"), "title").alias("a")).collect()}
    assert [found[i] for i in range(len(cases))] == [w for *_, w in cases]
