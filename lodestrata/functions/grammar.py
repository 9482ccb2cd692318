"""Projections over the text of a chunk: header lines, bullet blocks, coverage, provenance, code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADERS = ("FQN", "Kind", "Deprecated", "Limitation", "Defined-In", "Exported-As", "Shadows", "Shadowed-By", "Alias-Of", "Source-Commit", "Provenance", "Verification-Level", "Runtime-Status", "Part")
BLOCKS = ("Bases", "Methods", "Properties", "Members")
LIMITATION = "not implemented in this build"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def header(text: Column | str, name: str) -> Column:
    """The first `name:` line's value, or null. Texts without `name:`, which most long ones are, are not matched."""
    found = F.nullif(F.regexp_extract(_col(text), rf"(?m)^{name}:[ \t]*(\S.*?)[ \t]*$", 1), F.lit(""))
    return F.when(_col(text).contains(f"{name}:"), found)


def headers(text: Column | str, name: str) -> Column:
    """All `name:` lines' values."""
    return F.regexp_extract_all(_col(text), F.lit(rf"(?m)^{name}:[ \t]*(\S.*?)[ \t]*$"), F.lit(1))


def fqn(text: Column | str) -> Column:
    return header(text, "FQN")


def bullets(text: Column | str, name: str) -> Column:
    """The `  - x` lines that follow a `name:` line at once."""
    block = F.regexp_extract(_col(text), rf"(?m)^{name}:[ \t]*\n((?:  - .*(?:\n|\z))*)", 1)
    return F.transform(F.filter(F.split(block, "\n"), lambda x: x != ""), lambda x: F.substring(x, 5, 1 << 30))


def signature(text: Column | str) -> Column:
    """bases, methods, properties, members and limitations as one struct."""
    return F.struct(*(bullets(text, b).alias(b.lower()) for b in BLOCKS), limitations(text).alias("limitations"))


def limitations(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(text), "\n"), lambda x: F.trim(x)), lambda x: x.contains(LIMITATION))


def member_name(line: Column) -> Column:
    """The name that a member line declares: what stands before a parenthesis, colon or blank."""
    return F.regexp_extract(line, r"([A-Za-z_]\w*)\s*(?:\(|:|=|$|\s[-–—(\[])", 1)


def declared_members(text: Column | str) -> Column:
    """Structs (header, line, name, declares): lines marked as inherited or promoted do not declare."""
    one = lambda block: F.transform(bullets(text, block), lambda line: F.struct(F.lit(block.lower()).alias("header"), line.alias("line"), member_name(line).alias("name"), (~F.regexp_like(line, F.lit(r"[\[(](?:inherited|promoted) from"))).alias("declares")))
    return F.concat(*(one(b) for b in BLOCKS[1:]))


def last_segment(name: Column | str) -> Column:
    return F.element_at(F.split(_col(name), r"::|\."), -1)


def separator(name: Column | str) -> Column:
    return F.when(_col(name).contains("::"), "::").otherwise(".")


def suffixes(name: Column | str) -> Column:
    """Every tail of a name that starts at a segment: what a shorter way to write it may be."""
    parts, sep = F.split(_col(name), r"::|\."), separator(name)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.replace(F.array_join(F.slice(parts, i, F.size(parts)), "\x00"), F.lit("\x00"), sep))


def coverage(text: Column | str) -> Column:
    """A struct (kept_types, types, kept_functions, functions) from an API-Coverage line; null without one."""
    line = header(text, "API-Coverage")
    number = lambda pattern, k: F.regexp_extract(line, pattern, k).try_cast("long")
    types, functions = r"(\d+) of (\d+) types", r"(\d+) of (\d+) functions"
    return F.when(line.isNotNull(), F.struct(number(types, 1).alias("kept_types"), number(types, 2).alias("types"), number(functions, 1).alias("kept_functions"), number(functions, 2).alias("functions")))


def coverage_note(text: Column | str) -> Column:
    """A sentence where something is left out, null where all is there or nothing is said."""
    c = coverage(text)
    part = lambda kept, all_, noun: F.when(c[kept] < c[all_], F.concat(c[kept].cast("string"), F.lit(" of "), c[all_].cast("string"), F.lit(f" {noun}")))
    said = F.concat_ws(" and ", part("kept_types", "types", "types"), part("kept_functions", "functions", "functions"))
    return F.when(said != "", F.concat(F.lit("This index holds "), said, F.lit(".")))


def example_code(text: Column | str) -> Column:
    """What follows the last line that is exactly `Example:`, without a trailing commit line and blank lines; null without one."""
    found = F.regexp_extract(_col(text), r"(?s)(?:\A|.*\n)Example:\n(.*)\z", 1)
    bare = F.regexp_replace(found, r"(?s)(?:\n+Source-Commit:[^\n]*)?\s*\z", "")
    return F.when(F.regexp_like(_col(text), F.lit(r"(?m)^Example:$")), bare)


def example_prose(text: Column | str) -> Column:
    """What stands before the marker, without header lines."""
    before = F.regexp_extract(_col(text), r"(?s)\A(.*?)(?:^|\n)Example:(?:\n|\z)", 1)
    return F.trim(F.regexp_replace(before, r"(?m)^[A-Z][\w-]*:.*$", ""))


def lead_in(text: Column | str) -> Column:
    """The first sentence of the last paragraph before the marker."""
    paragraphs = F.filter(F.transform(F.split(example_prose(text), r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")
    last = F.when(F.size(paragraphs) > 0, F.element_at(paragraphs, -1)).otherwise("")
    return F.regexp_extract(last, r"(?s)\A(.*?[.!?:])(?:\s|\z)", 1)


def runtime(text: Column | str) -> Column:
    """A struct (status, level, rank) of an example's run; examples that ran sort first."""
    status = F.lower(F.coalesce(header(text, "Runtime-Status"), F.lit("unknown")))
    rank = F.when(F.regexp_like(status, F.lit("^ran")), 0).when(F.regexp_like(status, F.lit("^compiled")), 1).when(status == "unknown", 2).otherwise(3)
    return F.struct(status.alias("status"), header(text, "Verification-Level").alias("level"), rank.alias("rank"))
