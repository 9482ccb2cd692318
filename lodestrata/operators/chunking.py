"""Cutting documents: fences, headings, paragraphs, greedy regrouping, oversize parts, HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, TARGET, MOST = 400, 2000, 7600
PIECE_CHARS = 1 << 20  # of parts that Python holds before it gives them out
FENCE = r"^[ \t]{0,3}(`{3,}|~{3,})"
HEADING = r"^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$"


def fenced(lines: Column) -> Column:
    """Which lines lie in a fence, its own lines included. A fence closes at a line of nothing but its character, at least as
    many; an unclosed one at the end."""

    def step(state: Column, line: Column) -> Column:
        run = F.regexp_extract(line, FENCE, 1)
        bare = F.trim(line)
        open_ = state["size"] > 0
        closes = open_ & (F.length(bare) >= state["size"]) & (bare == F.repeat(state["mark"], F.length(bare)))
        starts = ~open_ & (run != "")
        return F.struct(
            F.when(starts, F.substring(run, 1, 1)).otherwise(state["mark"]).alias("mark"),
            F.when(closes, 0).when(starts, F.length(run)).otherwise(state["size"]).alias("size"),
            F.array_append(state["out"], open_ | starts).alias("out"),
        )

    first = F.struct(F.lit("").alias("mark"), F.lit(0).alias("size"), F.array().cast("array<boolean>").alias("out"))
    return F.aggregate(lines, first, step)["out"]


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part, title, text: by headings outside fences (what comes before the first has an empty title; an empty section's
    text is its title), else by blank lines, else whole. Empty documents give none.

    One array per document: nothing is shuffled."""
    body = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"))
    body = F.regexp_replace(body, r"\A\s+|\s+\z", "")
    lined = docs.select(F.col(key), body.alias("body")).withColumn("lines", F.split("body", "\n")).withColumn("fenced", fenced(F.col("lines")))
    heading = F.transform(F.arrays_zip("lines", "fenced"), lambda x: F.when(~x["fenced"] & F.regexp_like(x["lines"], F.lit(HEADING)), F.regexp_extract(x["lines"], HEADING, 2)))
    lined = lined.withColumn("heading", heading)
    starts = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda i: F.get("heading", i - 1).isNotNull())
    lined = lined.withColumn("starts", starts)
    clean = lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", "")
    cut = lambda a, b: clean(F.array_join(F.slice("lines", a, F.greatest(b - a, F.lit(0))), "\n"))
    end = F.size("lines") + 1
    preamble = cut(F.lit(1), F.get("starts", 0))
    one = lambda s, i: F.struct(F.get("heading", s - 1).alias("title"), F.coalesce(F.nullif(cut(s + 1, F.coalesce(F.get("starts", i + 1), end)), F.lit("")), F.get("heading", s - 1)).alias("text"))
    untitled = lambda x: F.struct(F.lit("").alias("title"), x.alias("text"))
    kind = "array<struct<title:string,text:string>>"
    by_heading = F.concat(F.when(preamble != "", F.array(untitled(preamble))).otherwise(F.array().cast(kind)), F.transform("starts", one))
    paragraphs = F.transform(F.filter(F.transform(F.split("body", r"\n\s*\n+"), clean), lambda p: p != ""), untitled)
    found = F.when(F.size("starts") > 0, by_heading).otherwise(paragraphs)
    return lined.select(key, F.posexplode(found.cast(kind)).alias("part", "section")).select(key, "part", "section.title", "section.text")


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n+"), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", "")), lambda p: p != "")
    return docs.select(key, F.posexplode(parts).alias("part", "text"))


def regrouped(texts: Column, least: int = LEAST, target: int = TARGET) -> Column:
    """Neighbouring sections joined into chunks: within a fence, after a colon, while short, or while the target is not
    passed; a short rest goes to the one before it."""
    inside = lambda t: F.size(F.filter(F.split(t, "\n"), lambda x: F.trim(x).startswith("```"))) % 2 == 1
    colon = lambda t: F.regexp_like(t, F.lit(r":\s*\z"))

    def step(state: Column, t: Column) -> Column:
        b = state["buffer"]
        joined = F.concat(b, F.lit("\n\n"), t)
        join = inside(b) | ((F.length(b) < least) & (F.length(t) <= target)) | colon(b) | (F.length(joined) <= target)
        return F.struct(
            F.when((b == "") | join, state["out"]).otherwise(F.array_append(state["out"], b)).alias("out"),
            F.when(b == "", t).when(join, joined).otherwise(t).alias("buffer"),
        )

    def last(state: Column) -> Column:
        b, out = state["buffer"], state["out"]
        glue = (F.size(out) > 0) & (F.length(b) < least) & ~inside(b)
        return F.when(b == "", out).when(glue, F.array_append(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.concat(F.element_at(out, -1), F.lit("\n\n"), b))).otherwise(F.array_append(out, b))

    first = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buffer"))
    return F.when(F.size(texts) > 0, F.aggregate(texts, first, step, last)).otherwise(F.array().cast("array<string>"))


def split_oversize(text: str, most: int = MOST) -> list[str]:
    """Parts of whole lines of at most `most` characters; a table's first two rows head every part."""
    if len(text) <= most:
        return [text]
    lines = text.split("\n")
    inked = [x for x in lines if x.strip()]
    rows = [x for x in lines if x.lstrip().startswith("|")]
    head = rows[:2] if inked and 2 * len(rows) >= len(inked) and 2 * len("\n".join(rows[:2])) <= most else []
    parts, now, fresh = [], [], 0
    for line in lines:
        for at in range(0, max(1, len(line)), most):
            piece = line[at : at + most]
            if fresh and len("\n".join([*now, piece])) > most:
                parts.append("\n".join(now))
                now, fresh = list(head), 0
            now.append(piece)
            fresh += 1
    return [*parts, "\n".join(now)] if fresh else parts


def _oversize_batches(batches: Iterator[pa.RecordBatch], key: str, most: int, chars: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """key, part, parts, text of batches (key, text), given out as soon as there are `chars` of them."""

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, pa.int32(), pa.int32(), pa.string()), strict=True)], names=[key, "part", "parts", "text"])

    for batch in batches:
        kind, rows, size = batch.schema.field(0).type, [], 0
        for k, t in zip(batch.column(0), batch.column(1), strict=True):
            parts = split_oversize(t.as_py() or "", most)
            rows += [(k.as_py(), i, len(parts), p) for i, p in enumerate(parts)]
            size += sum(map(len, parts))
            if size >= chars:
                yield given(rows)
                rows, size = [], 0
        if rows:
            yield given(rows)


def oversize_parts(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """key, part, parts, text. A line-by-line walk with state over Arrow batches; a row at a time is Python's."""
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(lambda batches: _oversize_batches(batches, key, most), f"{key} {kind}, part int, parts int, text string")


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part, parts, text: sections, regrouped, cut where too long, and numbered with `Part: i of n` lines."""
    listed = sections(docs, key, text).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda s: s["text"]).alias("texts"))
    merged = listed.select(key, F.posexplode(regrouped(F.col("texts"))).alias("group", "text"))
    cut = oversize_parts(merged.select(F.struct(key, "group").alias("k"), "text").withColumn("k", F.to_json("k")), "k", "text")
    parsed = cut.select(F.from_json("k", f"{key} bigint, `group` int").alias("k"), "part", "text").select(f"k.{key}", "k.group", "part", "text")
    listed = parsed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("group", "part", "text"))).alias("all"))
    one = listed.select(key, F.size("all").alias("parts"), F.posexplode("all").alias("part", "x"))
    said = F.when(F.col("parts") > 1, F.concat(F.col("x.text"), F.lit("\nPart: "), (F.col("part") + 1).cast("string"), F.lit(" of "), F.col("parts").cast("string"))).otherwise(F.col("x.text"))
    return one.select(key, "part", "parts", said.alias("text"))


def html_text(html: Column | str) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    h = F.col(html) if isinstance(html, str) else html
    for pattern, to in ((r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), (r"(?is)<(?:br|/p|/div|/h[1-6]|/li)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", ""), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        h = F.regexp_replace(h, pattern, to)
    return F.trim(F.regexp_replace(F.regexp_replace(h, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def html_title(html: Column | str) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    return F.nullif(F.trim(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def sentences(text: Column | str) -> Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda s: s != "")


def table_cells(row: Column | str) -> Column:
    r = F.col(row) if isinstance(row, str) else row
    return F.transform(F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
