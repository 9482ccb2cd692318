"""Versions, release notes and drift as Column builders."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Verbs of change, lines that say nothing, spans of code.
CHANGE = (
    r"(?i)\b(fix(?:ed|es|ing)?|add(?:ed|s|ing)?|remov(?:ed|es|al)?|improv(?:ed|es|ement)?|"
    r"resolv(?:ed|es)?|deprecat(?:ed|es|ion)?|introduc(?:ed|es)?|support(?:ed|s|ing)?|"
    r"chang(?:ed|es)?|updat(?:ed|es)?|refactor(?:ed|s)?|optimiz(?:ed|es)?|"
    r"preserv(?:ed|es)?|avoid(?:ed|s)?|synchroniz(?:ed|es)?|correct(?:ed|s)?|"
    r"prevent(?:ed|s)?|broke|break(?:ing|s)?|regress(?:ed|ion)?|reproduc(?:ed|es)?)\b"
)
BOILERPLATE = (
    r"(?i)^#+\s*what.?s changed",
    r"(?i)^\*\s+.*\bby\s+@[\w-]+\s+in\s+(https?://\S+|#\d+)",
    r"(?i)^\*\*full changelog\*\*",
    r"(?i)^#+\s*new contributors",
    r"(?i)^\*\s+@[\w-]+ made (their|his|her) first contribution",
)
SPECIFIC = r"`[^`\n]+`"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parsed(tag: Column | str) -> Column:
    """The first dotted run of two or more numbers as an array, or null."""
    run = F.regexp_extract(_col(tag), r"\d+(?:\.\d+)+", 0)
    return F.when(run != "", F.transform(F.split(run, r"\."), lambda x: x.cast("int")))


def padded(version: Column, width: Column) -> Column:
    return F.concat(version, F.array_repeat(F.lit(0), width - F.size(version)))


def compared(a: Column, b: Column) -> Column:
    """-1, 0 or 1 after padding with zeros; null where one is."""
    width = F.greatest(F.size(a), F.size(b))
    x, y = padded(a, width), padded(b, width)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("int")).when(x < y, -1).when(x > y, 1).otherwise(0)


def alignment(tag: Column | str, commit: Column, indexed_commit: Column, indexed: Column) -> Column:
    """How a release stands to the index: a struct (in_index, basis); unknown is null."""
    v = parsed(tag)
    same_major = F.get(v, 0) == F.get(indexed, 0)
    newer = compared(v, indexed) > 0
    basis = F.when(F.lower(F.trim(commit)) == F.lower(F.trim(indexed_commit)), "commit_equal").when(same_major & newer, "version_newer").when(same_major, "version_not_newer").otherwise("unknown")
    return F.struct(F.when(basis.isin("commit_equal", "version_not_newer"), True).when(basis == "version_newer", False).alias("in_index"), basis.alias("basis"))


def drift(ahead: Column, behind: Column) -> Column:
    """Five states; a missing or negative count is unknown, never in sync."""
    return (
        F.when(ahead.isNull() | behind.isNull() | (ahead < 0) | (behind < 0), "unknown")
        .when((ahead > 0) & (behind > 0), "diverged")
        .when(ahead > 0, "index_ahead_of_package")
        .when(behind > 0, "package_ahead_of_index")
        .otherwise("in_sync")
    )


def richness(body: Column | str) -> Column:
    """none, templated or detailed: detailed names a change, and code or a number that is no version, outside of fences."""
    b = _col(body)
    says = F.lit(False)
    lines = F.filter(F.transform(F.split(b, r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    empty = lambda x: functools.reduce(lambda a, p: a | F.regexp_like(x, F.lit(p)), BOILERPLATE, says)
    bare = F.regexp_replace(b, "(?s)```.*?```", " ")
    specific = F.regexp_like(bare, F.lit(SPECIFIC)) | F.regexp_like(F.regexp_replace(bare, r"\b\d+(?:\.\d+){1,3}\b", " "), F.lit(r"\b\d[\d,]+\b"))
    return (
        F.when(~F.regexp_like(F.coalesce(b, F.lit("")), F.lit(r"\S")), "none")
        .when(~F.exists(lines, lambda x: ~empty(x)), "templated")
        .when(F.regexp_like(bare, F.lit(CHANGE)) & specific, "detailed")
        .otherwise("templated")
    )


def indexed_at(generation_id: Column | str) -> Column:
    """The time stamp in a generation's id."""
    return F.try_to_timestamp(F.regexp_extract(_col(generation_id), r"(\d{8}T\d{6})", 1), F.lit("yyyyMMdd'T'HHmmss"))


def negotiated(requested: Column, supported: Column) -> Column:
    """A struct (revision, fallback, error): the requested date where it is supported, else the newest supported one that is
    not after it (fallback unknown_revision), else the oldest (below_min_supported). A missing date and one that is none are
    errors (missing, malformed), and there is no revision then."""
    asked = F.trim(requested)
    day = lambda x: F.try_to_date(F.regexp_extract(x, r"^\s*(\d{1,4}-\d{1,2}-\d{1,2})\s*$", 1), "y-M-d")
    dated = F.array_sort(F.filter(F.transform(supported, lambda x: F.struct(day(x).alias("day"), F.trim(x).alias("revision"))), lambda x: x["day"].isNotNull()))

    def chosen(dates: Column) -> Column:
        fit = F.filter(dates, lambda x: x["day"] <= day(asked))
        error = F.when(F.coalesce(asked, F.lit("")) == "", "missing").when(day(asked).isNull(), "malformed")
        fallback = F.when(F.exists(dates, lambda x: x["revision"] == asked), "none").when(F.size(fit) == 0, "below_min_supported").otherwise("unknown_revision")
        revision = F.when(fallback == "none", asked).when(F.size(fit) > 0, F.element_at(fit, -1)["revision"]).otherwise(F.get(dates, 0)["revision"])
        return F.struct(F.when(error.isNull(), revision).alias("revision"), F.when(error.isNull(), fallback).alias("fallback"), error.alias("error"))

    return let(dated, chosen)
