"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations

from lodestrata.functions.text import GENERIC, STOPWORDS


def strings(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP = strings(STOPWORDS)
GENERIC_WORDS = strings(GENERIC)


def plain_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def case_parts(x: str) -> str:
    cut = x
    for pattern in ("([A-Z]+)([A-Z][a-z])", "([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        cut = f"regexp_replace({cut}, '{pattern}', '\\1 \\2', 'g')"
    return f"string_split({cut}, ' ')"


def tokens(x: str) -> str:
    parts = f"flatten(list_transform(list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9]+'), lambda r: {case_parts('r')}), lambda p: len(p) > 1), lambda p: list_transform(p, lambda y: lower(y))))"
    return f"list_filter(list_concat({plain_tokens(x)}, {parts}), lambda t: t NOT IN ({STOP}))"


def stem(x: str) -> str:
    """x: lower-case, without blanks around it."""
    return (
        f"(CASE WHEN {x} LIKE '%ations' AND length({x}) > 6 THEN left({x}, -6) WHEN {x} LIKE '%ation' AND length({x}) > 5 THEN left({x}, -5) "
        f"WHEN {x} LIKE '%ings' AND length({x}) >= 7 THEN left({x}, -4) WHEN {x} LIKE '%ing' AND length({x}) >= 6 THEN left({x}, -3) "
        f"WHEN {x} LIKE '%ies' AND length({x}) > 3 THEN left({x}, -3) || 'y' WHEN regexp_matches({x}, '(s|x|z|ch|sh)es$') THEN left({x}, -2) "
        f"WHEN length({x}) > 3 AND {x} LIKE '%s' AND {x} NOT LIKE '%ss' THEN left({x}, -1) WHEN length({x}) > 4 AND {x} LIKE '%ed' THEN left({x}, -2) ELSE {x} END)"
    )


def stemmed_terms(x: str) -> str:
    """Without plural acronyms, possessives and conversational words, which the driver's tables do not hold."""
    stems = f"list_distinct(list_transform({tokens(x)}, lambda t: {stem('t')}))"
    return f"list_filter({stems}, lambda t: NOT regexp_matches(t, '^[a-z]$'))"


def symbol_words(x: str) -> str:
    cut = f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(list_transform(regexp_split_to_array({cut}, '[\\s._:]+'), lambda w: lower(w)), lambda w: w <> '')"


#: A made-up name for each part, from its own words: Economy.SmallRing.B7.
PART_NAME = "concat(upper(left(p_type, 1)), lower(substr(p_type, 2)), '.', list_aggregate(list_transform(string_split(p_name, ' '), lambda w: concat(upper(left(w, 1)), substr(w, 2))), 'string_agg', ''), '.', 'B', regexp_extract(p_brand, '[0-9]+'))"
