"""Examples of READMEs against a plain walk over the lines and blocks."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import examples

CASES = [
    ("python", "import a.b\nfrom c import (d,  # x)\n    e)  \n# note\nrun()", [("import a.b", "a.b"), ("from c import (d,  # x)\n    e)", "c")], True, False),
    ("python", "from __future__ import annotations\nimport os", [("import os", "os")], False, False),
    ("python", "from .. import x, \\\n  y\r\nfrom .m import z", [("from .. import x, \\\n  y", ".."), ("from .m import z", ".m")], True, True),
    ("python", "def f():\n    import os", [], False, False),
    ("python", "import a (", [("import a (", "a")], True, True),
    ("dotnet", "// a\nusing A.B;\nglobal using static C.D; // x\nusing E = F.G<int>;\nusing var s = Open();\nusing (x) {}", [("using A.B;", "A.B"), ("global using static C.D; // x", "static C.D"), ("using E = F.G<int>;", "E")], True, False),
    ("rust", "/* a\n b */ x\nuse a::{b,\n  c // ;\n};\npub(crate) use d::e;\nextern crate f as g;", [("use a::{b,\n  c // ;\n};", "a"), ("pub(crate) use d::e;", "d::e"), ("extern crate f as g;", "extern crate f")], True, True),
    ("rust", "use a::b", [], False, False),
    ("go", 'package main\nimport (\n\t"fmt" // f\n\tm "a/b"\n)\nimport `c`\nfunc main() {}', [('import "fmt"', "fmt"), ('import m "a/b"', "a/b"), ("import `c`", "c")], True, False),
    ("go", "package main", [], True, True),
    ("java", "package a.b;\nimport static c.D.*;\nimport e.F; // x\n* y", [("import static c.D.*;", "c.D.*"), ("import e.F; // x", "e.F")], True, True),
    ("typescript", "import {\n  A,\n  B } from 'x';\nimport 'y'\nconst z = require(\"q\");\nimport('w')\nimport.meta", [("import {\n  A,\n  B } from 'x';", "x"), ("import 'y'", "y"), ('const z = require("q");', "q")], True, False),
    ("nodejs", "import a from 'b\"\nc()", [], False, False),
    ("cpp", "#pragma once\n  #include <a/b.h> /* x */\nusing namespace c::d;\nusing e::f;\nusing g = h;", [("#include <a/b.h> /* x */", "a/b.h"), ("using namespace c::d;", "namespace c::d"), ("using e::f;", "e::f")], True, False),
    ("cpp", "#ifdef A\n#endif", [], False, False),
    ("java", "", [], False, False),
]


@pytest.mark.parametrize("platform", sorted(examples.SYNTAX))
def test_import_lines(spark, platform):
    cases = [(i, *c[1:]) for i, c in enumerate(CASES) if c[0] == platform]
    rows = spark.createDataFrame([(i, code) for i, code, *_ in cases], "i int, code string")
    found = {r.i: r.x for r in rows.select("i", examples.imports("code", platform).alias("x")).collect()}
    for i, _, units, starts, only in cases:
        assert [tuple(u) for u in found[i].units] == units, CASES[i]
        assert (found[i].starts, found[i].only) == (starts, only), CASES[i]


def test_long_code_ends_neither_engine_nor_patience(spark):
    n = 200_000
    texts = ['"' + "a\\n" * n + '"', "use a::{" + "b,\n" * n + "};", "import (" + "x," * n, "from a import (" + "# ((\nb, " * n + ")", "x = '" + "Ab1" * n + "'", "/*" + " *\n" * n, "import {" + "a,\n" * n, " " * n + "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "code string")
    for platform in ("python", "rust", "go", "nodejs"):
        assert rows.select(examples.imports("code", platform)["only"], examples.truncated("code")).count() == len(texts)
        assert len(rows.select(examples.imports("code", platform)["starts"].alias("a"), examples.truncated("code").alias("b")).where("b").collect()) == 0


def test_cut_payloads(spark):
    mixed = "Ab1" * 11
    cases = [(f'x = "{mixed}..."', True), (f'x = "{mixed}"', False), ("x = 'iVBORw0KGgo…'", True), ("# iVBORw0KGgo...", False), ('"Loading..."', False), (f"'{'ab1' * 11}...'", False), ("`data:base64,...`", True), ('"a\\"/9j/4A..."', True), ('"""\n/9j/...\n"""', True), (f'"-{mixed}==…"', True), (None, None)]
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, code string")
    found = {r.i: r.x for r in rows.select("i", examples.truncated("code").alias("x")).collect()}
    assert [found[i] for i in range(len(cases))] == [w for _, w in cases]


def plain_units(code):
    """Of one-line Python imports: units, starts, only."""
    lines = [x for x in code.split("\n") if x.strip() and not x.strip().startswith("#")]
    kinds = [re.match(r"(?:import|from) (?!__future__)(\w+)", x) for x in lines]
    return [(x.strip(), k[1]) for x, k in zip(lines, kinds, strict=True) if k], bool(kinds and kinds[0]), bool(kinds) and all(kinds)


def plain_supply(blocks):
    rows, seen, titles, counts = [], set(), [], [0, 0, 0]
    for title, content, origin, chain in blocks:
        n, end = 0, 0
        for m in re.finditer(r"(?s)```[ \t]*([^\n`]*)\n(.*?)```", content or ""):
            before, end = content[end : m.start()].strip(), m.end()
            code = m[2].strip()
            if m[1].strip() not in ("python", "{.py}"):
                counts[1] += 1
            elif "/9j/..." in code:
                counts[2] += 1
            else:
                n += 1
                own = title if n == 1 else f"{title} (part {n})"
                digest = hashlib.sha256("\n".join(x.rstrip() for x in code.split("\n")).encode()).hexdigest()
                if digest in seen:
                    counts[0] += 1
                    continue
                seen.add(digest)
                k = 2
                free = own
                while free in titles:
                    free, k = f"{own} ({k})", k + 1
                titles.append(free)
                rows.append([free, before, m[1].strip(), code, origin, digest, chain])
    out = []
    for i, row in enumerate(rows):
        units, starts, only = plain_units(row[3])
        prefix = []
        if not starts and "from __future__" not in row[3]:
            earlier = []
            for other in reversed(rows[:i]):
                if other[6] == row[6]:
                    earlier.insert(0, plain_units(other[3]))
                    if earlier[0][1]:
                        break
            held = {k for _, k in units}
            for text, k in (u for e in earlier for u in e[0]):
                if k not in held:
                    held.add(k)
                    prefix.append(text)
        out.append((*row[:6], starts, only, prefix))
    return out, counts


def page(seed):
    draw = random.Random(seed)
    line = lambda: draw.choice(["import a", "import b", "from c import d", "run()", "x = 1  ", "# note", "from __future__ import y", "", "import a as z", 's = "/9j/..."'] + ["use(1)"] * 4)
    fence = lambda: f"About {draw.randrange(9)}.\n```{draw.choice(['python', 'python', ' {.py}', 'text', ''])}\n" + "\n".join(line() for _ in range(draw.randint(0, 3))) + "\n```\n"
    make = lambda chain: (draw.choice(["A", "A", "A (2)", "B", "A (part 2)"]), "".join(fence() for _ in range(draw.randint(0, 4))) + "end", "single" if chain == "single" else "content", chain)
    return [make("single") for _ in range(draw.randint(0, 4))] + [make(f"{n} left") for n in range(draw.randint(0, 4))]


def test_supplies_are_those_of_the_walk(spark):
    pages = [(i, page(i)) for i in range(120)]
    kind = "page int, fields array<struct<title:string,content:string,origin:string,chain:string>>"
    found = {r.page: r for r in examples.supplies(spark.createDataFrame(pages, kind), "python").collect()}
    fallbacks = 0
    for i, blocks in pages:
        want, (duplicates, other, cut) = plain_supply(blocks)
        fallbacks += found[i].fallback
        assert found[i].fallback == (not want and not cut)
        if not found[i].fallback:
            assert [tuple(c) for c in found[i].candidates] == want
            assert (found[i].duplicates, found[i].other_language, found[i].truncated) == (duplicates, other, cut)
    assert 0 < fallbacks < 60


def test_pages_without_a_fence_of_the_platform(spark):
    kind = "page int, fields array<struct<title:string,content:string,origin:string,chain:string>>"
    go = "a\n```go\nx\n```\n```go\ny\n```"
    pages = spark.createDataFrame([(1, [("T", go, "single", "single"), ("T", go, "content", "0 left"), (None, go, "single", "single"), ("U", None, "single", "single")]), (2, None), (3, []), (None, [("T", "```py\n```", "single", "single")])], kind)
    rows = {r.page: r for r in examples.supplies(pages, "python").collect()}
    assert [(c.title, c.description, c.code, c.language) for c in rows[1].candidates] == [("T", "a", "x", "go")] and rows[1].fallback
    assert rows[2].candidates == rows[3].candidates == [] and rows[2].fallback
    assert [c.code for c in rows[None].candidates] == [""] and not rows[None].fallback
    with pytest.raises(ValueError, match="unknown platform"):
        examples.supplies(pages, "cobol")


def test_fields_of_a_page_and_what_a_verifier_gets(spark):
    kind = "page int, single array<struct<title:string,content:string>>, content array<struct<title_left:string,content_left:string,title_right:string,content_right:string>>"
    fence = lambda code: f"```ts\n{code}\n```"
    pages = spark.createDataFrame([(1, [("S", fence("import 'a'\nf()"))], [("L", fence("import 'b'\ng()") + fence("h()"), "R", fence("i()")), (None, "x", "Q", None)]), (2, None, None)], kind)
    own = pages.select("page", examples.fields(F.col("single"), F.col("content")).alias("fields"))
    assert [(f.title, f.chain) for f in own.where("page = 1").first().fields] == [("S", "single"), ("L", "0 left"), ("R", "0 right")]
    rows = examples.candidates(own, "typescript").orderBy("place").collect()
    assert [(r.page, r.title, r.verified_code) for r in rows] == [(1, "S", "import 'a'\nf()"), (1, "L", "import 'b'\ng()"), (1, "L (part 2)", "import 'b'\nh()"), (1, "R", "i()")]
    plain = examples.candidates(own.select("page", F.transform("fields", lambda f: f.withField("content", F.replace(f["content"], F.lit("ts"), F.lit("go")))).alias("fields")), "go")
    assert [r.verified_code for r in plain.orderBy("place").collect()][2] == "h()"
