"""Classifiers and predicates over chunk texts and queries."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import grammar
from .binding import let

#: Title and word patterns of the four documentation categories, in the order in which they are tried; question
#: words; titles that name no task.
TROUBLE_TITLE = r"(?i)troubleshoot|known issue|limitation|unsupported|error|problem"
START_TITLE = r"(?i)install|quick ?start|getting started|prerequisite|\bsetup\s*$|dependenc|requirement"
HINTS = {
    "getting_started": ("getting started", "quickstart", "quick start", "installation", "install ", "prerequisites"),
    "troubleshooting": ("troubleshoot", "known issue", "common error", "debugging"),
    "faq": ("faq", "frequently asked"),
}
CATEGORIES = ("faq", "troubleshooting", "getting_started", "developer_guide")
TABLE_LINE = r"^\s*(?:\||- +`[^`]+`\s*[-:–—])"
QUESTION_WORDS = ("how", "what", "why", "can", "could", "does", "do", "did", "is", "are", "was", "were", "should", "would", "will", "where", "when", "who", "which", "shall")
TASK_WORDS = 3
GENERIC_TITLES = ("quick start", "getting started", "additional examples", "more examples", "basic usage", "installation, dependencies, and quick start")
GENERIC_SUFFIX = r"(?i)\s*\((?:part\s*)?\d+\)\s*$"

#: Phrases of licence texts, lower-case with single blanks.
MIT = (
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
)
APACHE = ("apache license", "version 2.0, january 2004")
BSD = "redistribution and use in source and binary forms, with or without modification, are permitted"
BSD_NEITHER = "neither the name of"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chunk_kind(text: Column | str) -> Column:
    """symbol, example or documentation, by the FQN line; documentation without one."""
    kind = lambda name: F.when(name.isNull() | name.startswith("Doc: "), "documentation").when(name.startswith("Example: "), "example").otherwise("symbol")
    return let(grammar.fqn(text), kind)


def verified_example(text: Column | str) -> Column:
    """Whether a chunk is an example that was verified: by its FQN line, its own line of its kind and the marker line; an
    authored one must also say that its verification passed."""
    t = _col(text)
    line = lambda said: F.regexp_like(t, F.lit(rf"(?m)^{said}\r?$"))
    of_kind = F.coalesce(grammar.fqn(text).startswith("Example: "), F.lit(False))
    return of_kind & line("Kind: verified_example") & line("Example:") & (~line("Provenance: authored") | line("Verification: passed"))


def category(text: Column | str) -> Column:
    """A documentation chunk's category: by its title, or by its own words where it has none."""
    t = _col(text)
    first = F.regexp_extract(t, r"\A([^\n]*)", 1)
    body = F.regexp_extract(t, r"\A[^\n]*\n([^\n]*)", 1)
    title = F.when(first.startswith("FQN: Doc: "), F.substring(first, 11, 1 << 30))
    low = F.lower(t)
    hinted = functools.reduce(lambda held, name: F.when(functools.reduce(lambda a, hint: a | low.contains(hint), HINTS[name], F.lit(False)), name).otherwise(held), reversed(HINTS), F.lit("developer_guide"))
    by_title = F.when(body.startswith("FAQ:"), "faq").when(F.regexp_like(title, F.lit(TROUBLE_TITLE)), "troubleshooting").when(F.regexp_like(title, F.lit(START_TITLE)), "getting_started").otherwise("developer_guide")
    return F.when(title.isNotNull(), by_title).otherwise(hinted)


def table_dominated(text: Column | str, share: float = 0.5, most: int = 8000) -> Column:
    """Whether at least a share of the lines that are not blank are table rows, or the text is very long."""
    lines = F.filter(F.split(_col(text), "\n"), lambda x: F.trim(x) != "")
    rows = F.filter(lines, lambda x: F.regexp_like(x, F.lit(TABLE_LINE)))
    return (F.length(_col(text)) > most) | ((F.size(lines) > 0) & (F.size(rows) >= share * F.size(lines)))


def task_question(query: Column | str) -> Column:
    """Three words or more, cut at blanks, or a question word first."""
    words = F.filter(F.split(_col(query), r"\s+"), lambda w: w != "")
    first = F.lower(F.regexp_replace(F.get(words, 0), r"^\p{Punct}+|\p{Punct}+$", ""))
    return (F.size(words) >= TASK_WORDS) | F.coalesce(first.isin(*QUESTION_WORDS), F.lit(False))


def not_available(text: Column | str) -> Column:
    """The paragraphs that say something is not there."""
    return F.filter(F.split(_col(text), r"\n\s*\n|\n(?=\s*[-*] )"), lambda p: F.regexp_like(p, F.lit(r"(?i)\bnot (?:yet )?(?:supported|available|implemented)\b|\bno support\b|\bcannot\b|\bunsupported\b")))


def generic_title(title: Column | str) -> Column:
    """Whether a title names no task, whatever number stands behind it."""
    return F.lower(F.trim(F.regexp_replace(_col(title), GENERIC_SUFFIX, ""))).isin(*GENERIC_TITLES)


def licence(text: Column | str) -> Column:
    """The SPDX name where exactly one licence's phrases are all in the text; null otherwise."""

    def named(low: Column) -> Column:
        all_of = lambda phrases: functools.reduce(lambda a, p: a & low.contains(p), phrases, F.lit(True))
        bsd = F.when(low.contains(BSD), F.when(low.contains(BSD_NEITHER), "BSD-3-Clause").otherwise("BSD-2-Clause"))
        hits = F.array_compact(F.array(F.when(all_of(MIT), "MIT"), F.when(all_of(APACHE), "Apache-2.0"), bsd))
        return F.when(F.size(hits) == 1, F.get(hits, 0))

    return let(F.regexp_replace(F.lower(_col(text)), r"\s+", " "), named)


def test_source(path: Column | str) -> Column:
    return F.regexp_like(_col(path), F.lit(r"(?i)(?:^|/)(?:tests?|testing|__tests__|spec)(?:/|$)|(?:^|/)test_[^/]*$|_test\.[a-z]+$|\.(?:test|spec)\.[jt]s$"))


def cosine_label(score: Column | str, floor: float = 0.55, sure: float = 0.65) -> Column:
    """confident, weak, or null under the floor."""
    s = _col(score)
    return F.when(s >= sure, "confident").when(s >= floor, "weak")


def drops(previous: Column, now: Column, most: float) -> Column:
    """Whether a count fell by more than a share of what it was."""
    return (previous > 0) & (now < previous * (1 - most))
