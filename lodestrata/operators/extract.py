"""Smaller extraction steps: conditional code, comments, interfaces, artifacts, run verdicts, unsupported marks."""

from __future__ import annotations

import re
import zipfile
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members that well-known interfaces imply.
INTERFACE_MEMBERS = {"IDisposable": ("Dispose",), "IComparable": ("CompareTo",), "IEnumerable": ("GetEnumerator",), "ICloneable": ("Clone",), "Iterable": ("iterator",), "Comparable": ("compareTo",), "AutoCloseable": ("close",), "Closeable": ("close",)}


def _false(condition: str) -> bool:
    """Whether a preprocessor condition can only be false: 0, false, or a conjunction with one of these."""
    bare = condition.strip()
    while bare.startswith("(") and bare.endswith(")"):
        bare = bare[1:-1].strip()
    if "||" in bare:
        return all(_false(x) for x in bare.split("||"))
    return any(x.strip() in ("0", "false") for x in bare.split("&&"))


def without_dead_branches(source: str) -> str:
    """Source without the code under `#if` conditions that can only be false; lines keep their numbers."""
    out, stack = [], []
    for line in source.split("\n"):
        m = re.match(r"\s*#\s*(if|elif|else|endif)\b(.*)", line)
        if m and m[1] == "if":
            stack.append(_false(m[2]))
        elif m and stack and m[1] == "elif":
            stack[-1] = _false(m[2])
        elif m and stack and m[1] == "else":
            stack[-1] = False
        elif m and stack and m[1] == "endif":
            stack.pop()
        out.append("" if any(stack) and not m else line)
    return "\n".join(out)


def live_code(files: DataFrame, text: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def live(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else without_dead_branches(t))

    return files.withColumn(text, live(text))


def first_sentence(comment: Column | str) -> Column:
    """The first sentence of a doc comment, whatever its marks: /** */, ///, //, #, XML tags."""
    c = F.col(comment) if isinstance(comment, str) else comment
    bare = F.regexp_replace(F.regexp_replace(c, r"(?m)^\s*(?:/\*\*?|\*/|\*|///?!?|#)?[ \t]?|\*/\s*$", ""), r"<[^>]+>", "")
    return F.trim(F.regexp_replace(F.regexp_extract(F.trim(bare), r"(?s)\A\s*(.*?(?:[.!?](?=\s|\z)|\z))", 1), r"\s+", " "))


def deprecation(doc: Column | str) -> Column:
    """A struct (deprecated, replacement) from a doc comment."""
    d = F.col(doc) if isinstance(doc, str) else doc
    return F.struct(F.regexp_like(d, F.lit(r"(?i)\bdeprecated\b|@deprecated|\[Obsolete")).alias("deprecated"), F.nullif(F.regexp_extract(d, r"(?i)\buse\s+`?([A-Za-z_][\w.:]*?)(?:\(\))?`?(?:\s+instead|[.,\s]|$)", 1), F.lit("")).alias("replacement"))


def implied_members(types: DataFrame, members: DataFrame) -> DataFrame:
    """owner, member, implied_by: what a type's interfaces imply and it does not list. types: name, bases."""
    table = F.create_map(*[x for k, v in INTERFACE_MEMBERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = types.select(F.col("name").alias("owner"), F.explode("bases").alias("base")).withColumn("implied_by", F.regexp_replace("base", r"<.*$", "")).select("owner", "implied_by", F.explode(F.element_at(table, F.col("implied_by"))).alias("member"))
    return rows.join(members.select("owner", "member"), ["owner", "member"], "left_anti").select("owner", "member", "implied_by").distinct()


def run_verdict(compiled: Column, ran: Column, exit_code: Column, output_bytes: Column) -> Column:
    """not_compiled, not_run, failed, no_output or ran."""
    return F.when(~F.coalesce(compiled, F.lit(False)), "not_compiled").when(~F.coalesce(ran, F.lit(False)), "not_run").when(F.coalesce(exit_code, F.lit(1)) != 0, "failed").when(F.coalesce(output_bytes, F.lit(0)) == 0, "no_output").otherwise("ran")


def artifact_problem(name: str, content: bytes) -> str | None:
    """What is wrong with an output file by its kind's structure; null where nothing is, or the kind is unknown."""
    kind = name.rsplit(".", 1)[-1].lower()
    if not content:
        return "empty"
    if kind == "pdf":
        return None if content.startswith(b"%PDF-") and b"%%EOF" in content[-1024:] else "no PDF"
    if kind == "png":
        return None if content.startswith(b"\x89PNG\r\n\x1a\n") and b"IEND" in content[-16:] else "no PNG"
    if kind in ("jpg", "jpeg"):
        return None if content.startswith(b"\xff\xd8") and content.rstrip(b"\0").endswith(b"\xff\xd9") else "no JPEG"
    if kind in ("docx", "xlsx", "pptx", "zip"):
        try:
            with zipfile.ZipFile(BytesIO(content)) as held:
                if held.testzip() is not None:
                    return "a damaged entry"
                return None if kind == "zip" or "[Content_Types].xml" in held.namelist() else "no content types"
        except zipfile.BadZipFile:
            return "no ZIP"
    return None


def artifact_problems(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    @F.pandas_udf("string")
    def problem(names: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([artifact_problem(n, c or b"") for n, c in zip(names, contents, strict=True)], dtype=object)

    return files.select(path, problem(path, content).alias("problem"))


def documented_unsupported(text: Column | str) -> Column:
    """The identifiers that a scope document says are not supported: its lines with a negation and code spans."""
    t = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"(?i)\b(?:not (?:yet )?(?:supported|implemented)|unsupported|out of scope)\b")))
    return F.array_distinct(F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"`([A-Za-z_][\w.:]*)(?:\(\))?`"), F.lit(1)))))


def mark_unsupported(types: DataFrame, documents: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """types with a column unsupported: whether a document says so of the name or of its last segment."""
    said = documents.select(F.explode(documented_unsupported(text)).alias("said")).distinct()
    whole = types.join(said.withColumnRenamed("said", name).withColumn("_a", F.lit(True)), name, "left")
    last = said.select(F.col("said").alias("_short"), F.lit(True).alias("_b"))
    return whole.withColumn("_short", F.element_at(F.split(name, r"\.|::"), -1)).join(last, "_short", "left").withColumn("unsupported", F.coalesce("_a", "_b", F.lit(False))).drop("_a", "_b", "_short")


def mentions(documents: DataFrame, names: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """name, n: how often names are written in texts, by words."""
    words = documents.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\w+"), F.lit(0))).alias(name))
    return words.join(names.select(name).distinct(), name).groupBy(name).agg(F.count("*").alias("n"))
