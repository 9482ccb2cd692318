"""Rules that decide whether a title, a line or a word answers a query, as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .binding import let

#: Queries that are nothing but the name of a documentation category, and words beside them that say nothing.
CATEGORY_PHRASES = {
    "getting started": "getting_started",
    "get started": "getting_started",
    "quick start": "getting_started",
    "quickstart": "getting_started",
    "install": "getting_started",
    "installing": "getting_started",
    "installation": "getting_started",
    "setup": "getting_started",
    "set up": "getting_started",
    "prerequisites": "getting_started",
    "requirements": "getting_started",
    "troubleshooting": "troubleshooting",
    "known issues": "troubleshooting",
    "known issue": "troubleshooting",
    "limitations": "troubleshooting",
    "scope and limitations": "troubleshooting",
    "faq": "faq",
    "faqs": "faq",
    "frequently asked questions": "faq",
}
CATEGORY_FILLER = (
    "a", "an", "the", "how", "to", "do", "i", "me", "my", "please", "show", "guide", "docs", "doc", "documentation",
    "page", "section", "tutorial", "for", "of", "on", "about", "this", "library", "and",
)

#: Words that name no type, the least length of one that does, the limits of title anchors, lines of a tree
#: diagram and the share of them that makes a fence one.
NAMING_NOISE = ("method", "methods", "class", "classes", "property", "properties", "api", "using", "what", "does")
NAMING_LEAST = 3
ANCHOR_TERMS = 4
PREFIX_LEAST, PREFIX_MORE = 4, 2
TREE_LINE = r"[├└┬┼│]|^\s*(?:\|\s+)*[|+`]-{2,}\s"
TREE_SHARE = 0.5

#: Bases of a lexical match that rest on the title; modes of the example search, with their reasons.
TITLE_BASES = ("exact_title", "title_word_and_example_text")
SEARCH_MODES = {
    "no example vectors in this generation": "lexical-only",
    "embedding gateway not configured": "lexical-only",
    "configured embedding dimension does not match the stored vectors": "lexical-only",
    "embedding gateway circuit open after repeated failures": "lexical+vector(gateway) degraded",
    "example vectors present and the embedding gateway is configured": "lexical+vector(gateway)",
}

#: A line that tells an agent to follow a skill, and what stands in its place.
SKILL = r"(?i)\bskills?\b"
CUE = r"(?i)\balways\b|\bfollow\b|\bmust\b|\bbefore doing anything\b"
REMOVED = '[a line instructing an AI agent to "follow a skill" was removed - a prompt-injection-shaped embedded instruction, not information about this library]'


#: Stems that stand for each other, on the query's side; stems that name what most examples do; verbs that say what
#: is done and verbs that say what kind of request it is; words of a task that name nothing.
SYNONYMS = (("convert", "conversion"), ("colour", "color"), ("tab", "sheet", "worksheet"), ("export", "save"))
GENERIC_TITLE = ("save", "open", "create", "page", "add", "text", "document", "load")
ACTIONS = (
    "check", "compile", "convert", "display", "download", "export", "fetch", "find", "generate", "handle", "import", "inspect",
    "list", "load", "open", "output", "parse", "print", "read", "render", "retrieve", "save", "search", "show", "store", "view",
    "write",
)
WEAK = (
    "add", "apply", "build", "call", "change", "create", "edit", "generate", "get", "give", "insert", "make", "modify", "new",
    "perform", "put", "run", "set", "update", "use",
)
FILLER = ("disk", "scratch")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def product_mentions(query: Column | str, brand: str, family: str) -> Column:
    """A product's dotted name as two words, unless a name goes on behind it: Brand.Family, not Brand.Family.Type."""
    pattern = rf"(?i)\b({re.escape(brand)})\.({re.escape(family)})\b(?!\.)"
    return F.regexp_replace(_col(query), pattern, "$1 $2")


def category_intent(query: Column | str) -> Column:
    """The category that a query names and nothing else; null for all others."""
    words = F.filter(T.plain_tokens(T.strip_zero_width(query)), lambda w: ~w.isin(*CATEGORY_FILLER))
    phrases = F.create_map(*[F.lit(x) for pair in CATEGORY_PHRASES.items() for x in pair])
    return F.try_element_at(phrases, F.array_join(words, " "))


def token_forms(token: Column | str) -> Column:
    """A word and its forms without a plural ending."""
    w = _col(token)
    long = F.length(w) > 3
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    return F.array_distinct(F.array_compact(F.array(w, F.when(w.endswith("es") & long, cut(2)), F.when(w.endswith("s") & long, cut(1)))))


def naming_tokens(query: Column | str, excluded: Column) -> Column:
    """The words of a query that could name a type, in order: blank-separated, without punctuation around them or a
    possessive, of three characters or more, no function word, no noise, and with a stem that is not excluded."""
    raw = F.transform(F.split(F.lower(_col(query)), r"\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, r"^\p{Punct}+|\p{Punct}+$", ""), r"['’]s$", ""))
    fit = lambda w: (F.length(w) >= NAMING_LEAST) & ~w.isin(*NAMING_NOISE) & ~w.isin(*T.STOPWORDS) & F.regexp_like(w, F.lit("[a-z0-9]")) & ~F.array_contains(excluded, T.stem(w))
    return F.filter(raw, fit)


def stands_for(term: Column | str, key=lambda word: word) -> Column:
    """The other members of a term's group of synonyms; key: what words are compared by."""
    groups = {key(w): sorted({key(x) for x in group} - {key(w)}) for group in SYNONYMS for w in group}
    others = F.create_map(*[x for w, rest in groups.items() for x in (F.lit(w), F.array(*map(F.lit, rest)))])
    return F.coalesce(F.try_element_at(others, _col(term)), F.array().cast("array<string>"))


def with_synonyms(term: Column | str) -> Column:
    """A term, and what stands for it."""
    return F.array_distinct(F.concat(F.array(_col(term)), stands_for(term)))


def title_anchored(terms: Column, title: Column | str) -> Column:
    """Whether one of a query's distinctive terms, or a synonym, is a word of the title; more than ANCHOR_TERMS terms need none.
    Of several terms none is anchored by a synonym that names what most examples do."""

    def anchored(words: Column) -> Column:
        generic = F.when(F.size(terms) > 1, F.array(*map(F.lit, GENERIC_TITLE))).otherwise(F.array().cast("array<string>"))
        return F.exists(terms, lambda t: F.array_contains(words, t) | (F.size(F.array_except(F.array_intersect(stands_for(t), words), generic)) > 0))

    return (F.size(terms) > ANCHOR_TERMS) | let(F.transform(T.tokens(title), T.stem), anchored)


def title_prefix_anchored(terms: Column, title: Column | str) -> Column:
    """Whether a term of four characters or more begins a word of the title that is at least two longer."""
    words = T.tokens(title)
    begins = lambda t: F.exists(words, lambda w: F.startswith(w, t) & (F.length(w) - F.length(t) >= PREFIX_MORE))
    return F.exists(terms, lambda t: (F.length(t) >= PREFIX_LEAST) & begins(t))


def code_anchored(required: Column, code: Column | str) -> Column:
    """Whether the code holds one of the query's identifiers."""
    return F.arrays_overlap(required, F.transform(T.tokens(code), T.stem))


def lexical_confidence(basis: Column | str) -> Column:
    return F.when(_col(basis).isin(*TITLE_BASES), "confident").otherwise("loose")


def search_mode(has_vectors: Column, configured: Column, dimension: Column, stored: Column, circuit_open: Column) -> Column:
    """A struct (mode, reason) of the example search."""
    none, gateway, size, circuit, ready = SEARCH_MODES
    reason = F.when(~has_vectors, none).when(~configured, gateway).when(dimension.isNull() | (dimension <= 0) | (dimension != stored), size).when(circuit_open, circuit).otherwise(ready)
    modes = F.create_map(*[F.lit(x) for pair in SEARCH_MODES.items() for x in pair])
    return F.struct(F.element_at(modes, reason).alias("mode"), reason.alias("reason"))


def without_agent_lines(text: Column | str) -> Column:
    """Lines that name a skill and tell what to do with it are replaced; their number stays."""
    told = lambda line: F.regexp_like(line, F.lit(SKILL)) & F.regexp_like(line, F.lit(CUE))
    return F.array_join(F.transform(F.split(_col(text), "\n", -1), lambda line: F.when(told(line), REMOVED).otherwise(line)), "\n")


def tree_lines(lines: Column, fences: Column) -> Column:
    """Which lines belong to a directory tree: those that draw one, and whole fences that are mostly such lines. fences: for
    every line the number of its fence, or null; a fence's first and last line are no body."""
    draws = F.transform(lines, lambda x: F.regexp_like(x, F.lit(TREE_LINE)))
    body = lambda f: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (F.get(fences, i) == f) & (F.get(fences, i - 1) == f) & (F.get(fences, i + 1) == f) & (F.trim(F.get(lines, i)) != ""))
    mostly = lambda f: F.size(F.filter(body(f), lambda i: F.get(draws, i))) >= F.greatest(TREE_SHARE * F.size(body(f)), F.lit(1))
    trees = F.filter(F.array_distinct(F.filter(fences, lambda f: f.isNotNull())), mostly)
    return F.transform(draws, lambda x, i: x | F.coalesce(F.array_contains(trees, F.get(fences, i)), F.lit(False)))
