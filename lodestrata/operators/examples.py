"""Examples of READMEs: the fenced code of one platform, its import lines, and what a later block takes from those before it."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.binding import let

#: The fence tags of each platform, the platforms whose later blocks get the import lines put in front, and how a
#: payload looks that was cut: after the mark of a data URI, of a known file type, or as a long mixed run.
TAGS = {
    "dotnet": ("csharp", "cs", "c#"),
    "python": ("python", "py", "python3"),
    "rust": ("rust", "rs"),
    "go": ("go", "golang"),
    "java": ("java",),
    "typescript": ("typescript", "ts"),
    "nodejs": ("javascript", "js", "mjs", "cjs", "node"),
    "cpp": ("cpp", "c++", "cxx", "cc"),
}
PREFIXED = ("python", "typescript", "nodejs")
CUT = r"(?:\.\.\.|…)"
MIXED = r"(?<![A-Za-z0-9+/])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])(?=[A-Za-z+/]*+[0-9])[A-Za-z0-9+/]{32,}+={0,2}"
PAYLOAD = rf"(?:base64,[A-Za-z0-9+/=_-]*+|(?:iVBORw0KGgo|/9j/|JVBERi0|R0lGOD|UEsDB|T2dnUw)[A-Za-z0-9+/=]*+|{MIXED}){CUT}"

FENCE = r"(?s)```[ \t]*([^\n`]*)\n(.*?)```"
#: Groups that repeat are possessive: the engine walks these in a loop, and not by recursion.
LITERAL = r'(?s)"""(?:.*?)"""|\'\'\'(?:.*?)\'\'\'|"(?:[^"\\\n]|\\[^\n])*+"|\'(?:[^\'\\\n]|\\[^\n])*+\'|`[^`]*+`'
WHITE = " \t\n\r\x0b\x0c"
UNITS = "array<struct<text:string,key:string>>"
NEVER = "(?!)"
END = r"[ \t]*(?://[^\n]*)?$"
NAME, WORD = r"[\p{L}_][\p{L}\p{N}_.]*+", r"[\p{L}\p{N}_]"
SLASHED = r"[ \t]*/\*(?s:.*?)(?:\*/|\z)[^\n]*|[ \t]*(?://|\*)[^\n]*"
SPEC = rf'(?:[A-Za-z_.]{WORD}*[ \t]+)?(?:"[^"\n]+"|`[^`\n]+`)'


class Syntax(NamedTuple):
    """How a platform writes import lines: patterns of whole lines, from the first column, in the order in which they are tried."""

    unit: str
    key: Callable[[Column], Column]
    package: str = NEVER
    comment: str = SLASHED
    aside: str = NEVER


def _first(*patterns: str, before: str = "") -> Callable[[Column], Column]:
    """The first group of the first pattern that is found."""
    return lambda unit: F.coalesce(*(F.when(F.regexp_like(unit, F.lit(p)), F.concat(F.lit(before if n else ""), F.regexp_extract(unit, p, 1))) for n, p in enumerate(patterns)))


def _used(unit: Column) -> Column:
    path = F.regexp_extract(F.regexp_replace(unit, r"\s+", " "), r"^(?:pub(?:\([^)]*\))? )?use ([^;{]*)", 1)
    return F.coalesce(F.concat(F.lit("extern crate "), F.nullif(F.regexp_extract(unit, rf"^extern[ \t]+crate[ \t]+({WORD}+)", 1), F.lit(""))), F.btrim(F.rtrim(F.rtrim(path), F.lit(":"))))


def _using(unit: Column) -> Column:
    said = lambda p, n: F.nullif(F.regexp_extract(unit, p, n), F.lit(""))
    alias, plain = rf"using[ \t]+({WORD}+)[ \t]*=", rf"using[ \t]+(static[ \t]+)?({NAME})"
    return F.coalesce(said(alias, 1), F.concat(F.when(F.regexp_like(unit, F.lit(r"using[ \t]+static[ \t]")), "static ").otherwise(""), said(plain, 2)))


def _included(unit: Column) -> Column:
    said = lambda p: F.nullif(F.regexp_extract(unit, p, 1), F.lit(""))
    return F.coalesce(F.btrim(said(r'include[ \t]*[<"]([^>"\n]+)')), F.concat(F.lit("namespace "), said(rf"namespace[ \t]+((?:{WORD}|:)+)")), said(rf"using[ \t]+((?:{WORD}|:)+)"))


_SCRIPT = Syntax(
    unit=rf"""(?:const|let|var)[ \t]+[^=\n]+?=[ \t]*require\([ \t]*(?<r>['"])[^'"\n]+\k<r>[ \t]*\)[ \t]*;?{END}|import(?:(?=[ \t]+(?![(.]))|(?=[{{*'"]))(?:[^'"`;]*?\bfrom)?\s*(?<q>['"])[^'"\n]+\k<q>[ \t]*;?{END}""",
    key=_first(r"""require\([ \t]*['"]([^'"\n]+)""", r"""['"]([^'"\n]+)"""),
)
SYNTAX = {
    "python": Syntax(
        unit=rf"(?:import[ \t]+{NAME}|from[ \t]+(?!__future__[ \t])(?:\.*{NAME}|\.+)[ \t]+import\b)(?:[^()#\n\\]|\((?:[^()#\n]|\n|#[^\n]*+)*+(?:\)|\z)|\\[ \t]*\n|\\|#[^\n]*+|\))*+$",
        key=_first(r"\Afrom[ \t]+([^ \t]+)", rf"\Aimport[ \t]+({NAME})"),
        comment=r"[ \t]*#[^\n]*",
    ),
    "dotnet": Syntax(unit=rf"(?:global[ \t]+)?using[ \t]+(?:[A-Za-z_]{WORD}*[ \t]*=[ \t]*[^;=\n]+|(?:static[ \t]+)?{NAME})[ \t]*;{END}", key=_using),
    "rust": Syntax(unit=rf"extern[ \t]+crate[ \t]+{WORD}+(?:[ \t]+as[ \t]+{WORD}+)?[ \t]*;{END}|(?:pub(?:\([^)\n]*\))?[ \t]+)?use[ \t](?:[^;/]|//[^\n]*+|/)*+;[^\n]*", key=_used),
    "go": Syntax(unit=rf"import[ \t]+{SPEC}{END}|import[ \t]*\([ \t]*(?://[^\n]*)?$(?s:.*?)(?:\n[ \t]*\)[^\n]*|\z)", key=_first('"([^"\n]+)"', "`([^`\n]+)`"), package=rf"package[ \t]+{WORD}+{END}"),
    "java": Syntax(unit=rf"import[ \t]+(?:static[ \t]+)?[A-Za-z_][\p{{L}}\p{{N}}_.]*(?:\.\*)?[ \t]*;{END}", key=_first(r"import[ \t]+(?:static[ \t]+)?([^ \t;]+)"), package=rf"package[ \t]+{NAME}[ \t]*;{END}"),
    "typescript": _SCRIPT,
    "nodejs": _SCRIPT,
    "cpp": Syntax(
        unit=rf"""[ \t]*#[ \t]*include[ \t]*[<"][^>"\n]+[>"][ \t]*(?://[^\n]*|/\*[^\n]*\*/[ \t]*)?$|using[ \t]+namespace[ \t]+[A-Za-z_](?:{WORD}|:)*[ \t]*;{END}|using[ \t]+(?!namespace\b)[A-Za-z_]{WORD}*(?:::[A-Za-z_]{WORD}*)++[ \t]*;{END}""",
        key=_included,
        aside=r"[ \t]*#[^\n]*",
    ),
}


def _syntax(platform: str) -> Syntax:
    if platform not in SYNTAX:
        raise ValueError(f"unknown platform {platform!r}; known are {', '.join(sorted(SYNTAX))}")
    return SYNTAX[platform]


def imports(code: Column | str, platform: str) -> Column:
    """units (text, key), starts, only: the import lines of code, whether its first line that counts is one or names the package, and
    whether all are. Lines end at LF; comments and empty lines do not count.

    One pattern cuts the code into comments, import units and other lines, so a unit of many lines is one match. Of a block of Go
    imports each line is a unit. `from __future__` is none. A unit whose end is missing goes to the end of Python or Go code."""
    c = F.col(code) if isinstance(code, str) else code
    s = _syntax(platform)
    tokens = F.regexp_extract_all(F.regexp_replace(c, "\r\n?", "\n"), F.lit(rf"(?md)^(?:{s.comment}|{s.unit}|{s.package}|{s.aside}|[^\n]*\S[^\n]*)"), F.lit(0))
    like = lambda x, p: F.regexp_like(x, F.lit(rf"(?md)\A(?:{p})\z"))
    kind = lambda x: F.when(like(x, s.comment), "none").when(like(x, s.unit), "unit").when(like(x, s.package), "package").when(like(x, s.aside), "none").otherwise("other")
    named = F.filter(F.transform(tokens, lambda x: F.struct(x.alias("text"), kind(x).alias("kind"))), lambda x: x["kind"] != "none")
    tidy = lambda x: F.btrim(F.regexp_replace(x, r"(?<![ \t])[ \t]++(?=\n|\z)", ""), F.lit(WHITE))
    unit = lambda text, of: F.struct(text.alias("text"), s.key(of).alias("key"))

    def parts(x: Column) -> Column:
        if platform != "go":
            return F.array(unit(tidy(x), x))
        each = F.transform(F.regexp_extract_all(x, F.lit(rf"(?md)^(?:import)?[ \t]*({SPEC}){END}"), F.lit(1)), lambda y: unit(F.concat(F.lit("import "), y), y))
        return each

    found = lambda t: F.struct(
        F.flatten(F.transform(F.filter(t, lambda x: x["kind"] == "unit"), lambda x: parts(x["text"]))).cast(UNITS).alias("units"),
        F.coalesce(F.get(t, F.lit(0))["kind"] != "other", F.lit(False)).alias("starts"),
        ((F.size(t) > 0) & F.forall(t, lambda x: x["kind"] != "other")).alias("only"),
    )
    return let(named, found)


def truncated(code: Column | str) -> Column:
    """Whether a string literal in code holds a payload that was cut."""
    c = F.col(code) if isinstance(code, str) else code
    return F.exists(F.regexp_extract_all(c, F.lit(LITERAL), F.lit(0)), lambda x: F.regexp_like(x, F.lit(PAYLOAD)))


def fields(single: Column, content: Column) -> Column:
    """title, content, origin, chain of a page's blocks (arrays of structs: title, content; title_left, content_left, title_right,
    content_right), in order: all single blocks are one chain, each side of a content block is its own."""
    piece = lambda title, text, origin, chain: F.struct(title.alias("title"), text.alias("content"), F.lit(origin).alias("origin"), chain.alias("chain"))
    none = F.array().cast("array<struct<title:string,content:string,origin:string,chain:string>>")
    own = F.transform(single, lambda b: piece(b["title"], b["content"], "single", F.lit("single")))
    sides = F.transform(content, lambda b, n: F.array(*(piece(b[f"title_{x}"], b[f"content_{x}"], "content", F.concat(n.cast("string"), F.lit(f" {x}"))) for x in ("left", "right"))))
    return F.filter(F.concat(F.coalesce(own, none), F.coalesce(F.flatten(sides), none)), lambda x: x["title"].isNotNull() & x["content"].isNotNull())


def _fences(field: Column, tags: tuple[str, ...]) -> Column:
    """held (the fences that count, numbered titles), other, cut, first (the first fence of any tag) of one field."""
    trim = lambda x: F.btrim(x, F.lit(WHITE))
    raw = F.struct(F.split(field["content"], FENCE, -1).alias("before"), F.regexp_extract_all(field["content"], F.lit(FENCE), F.lit(1)).alias("info"), F.regexp_extract_all(field["content"], F.lit(FENCE), F.lit(2)).alias("code"))
    tag = lambda info: F.regexp_extract(F.lower(info), r"^\s*\{*\s*\.*([a-z0-9_#+.-]*)", 1)
    fits = lambda info, code: F.when(~tag(info).isin(*tags), "other").when(truncated(code), "cut").otherwise("held")
    listed = let(raw, lambda r: F.transform(r["code"], lambda code, i: F.struct(trim(F.get(r["before"], i)).alias("description"), trim(F.get(r["info"], i)).alias("language"), trim(code).alias("code"), fits(F.get(r["info"], i), code).alias("fits"))))
    titled = lambda x, title: F.struct(title.alias("title"), x["description"].alias("description"), x["language"].alias("language"), x["code"].alias("code"), field["origin"].alias("origin"), field["chain"].alias("chain"))
    part = lambda n: F.when(n == 0, field["title"]).otherwise(F.concat(field["title"], F.lit(" (part "), (n + 1).cast("string"), F.lit(")")))
    count = lambda all_, kind: F.size(F.filter(all_, lambda x: x["fits"] == kind))
    return let(
        listed,
        lambda all_: F.struct(
            F.transform(F.filter(all_, lambda x: x["fits"] == "held"), lambda x, n: titled(x, part(n))).alias("held"),
            count(all_, "other").alias("other"),
            count(all_, "cut").alias("cut"),
            F.transform(F.slice(all_, 1, 1), lambda x: titled(x, field["title"])).alias("first"),
        ),
    )


def distinct_titles(titles: Column) -> Column:
    """Titles made different, in order: one that is taken gets the least free number from 2 behind it."""

    def number(used: Column, title: Column) -> Column:
        said = F.transform(used, lambda x: F.when(F.startswith(x, F.concat(title, F.lit(" ("))), F.regexp_extract(x, r" \(([1-9][0-9]{0,8})\)\z", 1)))
        numbers = F.zip_with(used, said, lambda x, n: F.when(x == F.concat(title, F.lit(" ("), n, F.lit(")")), n.try_cast("int")))
        ordered = F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n >= 2)))
        return let(ordered, lambda o: F.coalesce(F.get(F.filter(F.transform(o, lambda n, i: F.when(n != i + 2, i + 2)), lambda n: n.isNotNull()), F.lit(0)), F.size(o) + 2))

    def step(used: Column, title: Column) -> Column:
        return F.array_append(used, F.when(F.array_contains(used, title), F.concat(title, F.lit(" ("), number(used, title).cast("string"), F.lit(")"))).otherwise(title))

    return F.when(F.size(F.array_distinct(titles)) == F.size(titles), titles).otherwise(F.aggregate(titles, F.array().cast("array<string>"), step))


def _carried(rows: Column, platform: str) -> Column:
    """Of rows (chain, found, code) the import lines of each that stand in its chain before it, since the last block that starts with
    imports, each key once and without its own keys; null for a block that starts with imports."""
    keys = lambda units: F.transform(units, lambda u: u["key"])
    without = lambda units, held: F.filter(units, lambda u: ~F.array_contains(keys(held), u["key"]))
    once = lambda units: F.filter(units, lambda u, i: F.array_position(keys(units), u["key"]) == i + 1)
    none = F.array().cast(UNITS)
    future = F.lit(r"(?m)^from[ \t]+__future__[ \t]+import\b")

    def step(state: Column, row: Column) -> Column:
        units = row["found"]["units"]
        before = F.when(state["chain"] == row["chain"], state["units"]).otherwise(none)
        prefix = F.when(F.regexp_like(row["code"], future) if platform == "python" else F.lit(False), none).otherwise(without(before, units))
        return F.struct(
            row["chain"].alias("chain"),
            F.when(row["found"]["starts"], once(units)).otherwise(F.concat(before, without(once(units), before))).alias("units"),
            F.array_append(state["out"], F.when(~row["found"]["starts"], F.transform(prefix, lambda u: u["text"]))).alias("out"),
        )

    first = F.struct(F.lit("").alias("chain"), none.alias("units"), F.array().cast("array<array<string>>").alias("out"))
    return F.aggregate(rows, first, step)["out"]


def supplies(pages: DataFrame, platform: str, key: str = "page", fields: str = "fields") -> DataFrame:
    """key, candidates, duplicates, other_language, truncated, fallback: what each page (key, fields: array of title, content, origin,
    chain) gives as examples of a platform, in order.

    Every fence of an accepted tag is one, unless a literal in it is cut or its code, but for white space at line ends, came
    before. The second of a field is `title (part 2)`, a title that is taken is numbered. Where a page has no such fence, cut
    ones included, the first fence of each single block is taken as it is, whatever its tag. Fields without title or content
    give none; null fields are no fields. All folds are over one page's array: nothing is shuffled."""
    tags = TAGS[platform] if _syntax(platform) else ()
    total = lambda per, name: F.aggregate(F.transform(per, lambda x: x[name]), F.lit(0), lambda a, b: a + b)
    hashed = lambda rows: F.transform(rows, lambda x: F.struct(x.alias("x"), T.code_hash(x["code"]).alias("hash"), imports(x["code"], platform).alias("found")))
    unseen = lambda rows: let(F.transform(rows, lambda r: r["hash"]), lambda h: F.filter(rows, lambda r, i: F.array_position(h, r["hash"]) == i + 1))

    def finished(rows: Column, titles: Column, prefixes: Column) -> Column:
        one = lambda r, i: F.struct(
            F.get(titles, i).alias("title"),
            *(r["x"][c].alias(c) for c in ("description", "language", "code", "origin")),
            r["hash"].alias("code_sha256"),
            r["found"]["starts"].alias("starts_example"),
            r["found"]["only"].alias("imports_only"),
            F.coalesce(F.get(prefixes, i), F.array().cast("array<string>")).alias("import_prefix"),
        )
        return F.transform(rows, one)

    def named(rows: Column) -> Column:
        bare = F.transform(rows, lambda r: F.struct(r["x"]["chain"].alias("chain"), r["x"]["code"].alias("code"), r["found"].alias("found")))
        return let(F.struct(distinct_titles(F.transform(rows, lambda r: r["x"]["title"])).alias("titles"), _carried(bare, platform).alias("prefixes")), lambda made: finished(rows, made["titles"], made["prefixes"]))

    def plain(rows: Column) -> Column:
        no = F.lit(False)
        return F.transform(rows, lambda x: F.struct(*(x[c].alias(c) for c in ("title", "description", "language", "code", "origin")), T.code_hash(x["code"]).alias("code_sha256"), no.alias("starts_example"), no.alias("imports_only"), F.array().cast("array<string>").alias("import_prefix")))

    none = F.array().cast("array<struct<title:string,content:string,origin:string,chain:string>>")
    whole = F.filter(F.coalesce(F.col(fields), none), lambda x: x["title"].isNotNull() & x["content"].isNotNull())
    per = pages.select(key, F.transform(whole, lambda f: _fences(f, tags)).alias("per"))
    held = per.select(key, F.flatten(F.transform("per", lambda x: x["held"])).alias("held"), total(F.col("per"), "other").alias("other"), total(F.col("per"), "cut").alias("truncated"), F.filter(F.flatten(F.transform("per", lambda x: x["first"])), lambda x: x["origin"] == "single").alias("first"))
    fallback = (F.size("held") == 0) & (F.col("truncated") == 0)
    kept = let(hashed(F.col("held")), unseen)
    out = held.select(key, "held", "other", "truncated", fallback.alias("fallback"), F.when(fallback, plain(F.col("first"))).otherwise(let(kept, named)).alias("candidates"))
    return out.select(key, "candidates", F.when(F.col("fallback"), 0).otherwise(F.size("held") - F.size("candidates")).alias("duplicates"), F.when(F.col("fallback"), 0).otherwise(F.col("other")).alias("other_language"), "truncated", "fallback")


def candidates(pages: DataFrame, platform: str, key: str = "page", fields: str = "fields") -> DataFrame:
    """key, place and the columns of one candidate of `supplies`, and the code that a verifier gets (verified_code): that of a later
    block with the import lines of its chain in front, where the platform's verifier takes none from the page."""
    rows = supplies(pages, platform, key, fields).select(key, F.posexplode("candidates").alias("place", "x")).select(key, "place", "x.*")
    if platform not in PREFIXED:
        return rows.withColumn("verified_code", F.col("code"))
    return rows.withColumn("verified_code", F.array_join(F.concat("import_prefix", F.array("code")), "\n"))
