"""Text scalars as Column builders: tokens, stems, query terms, identifiers. No Python code runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: English function words that are no index terms.
STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further "
    "had hadn't has hasn't have haven't having he her here hers herself him himself his how i if in into is isn't it its itself me more most my myself no nor not of off on once only or other our ours ourselves out over own "
    "same she should shouldn't so some such than that the their theirs them themselves then there these they this those through to too under until up very was wasn't we were weren't what when where which while who whom why will with won't would wouldn't you your yours yourself yourselves"
).split()

#: The pattern of a run's case parts, irregular stems, words that name no task.
CASE_PARTS = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
IRREGULAR = {"children": "child", "indices": "index", "vertices": "vertex", "matrices": "matrix"}
GENERIC = ("library", "api", "example", "examples", "sample", "samples", "use", "how")

ZERO_WIDTH = "[\\u200B\\u200C\\u200D\\u2060\\uFEFF]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def plain_tokens(text: Column | str) -> Column:
    """All `[a-z0-9]+` runs of the lower-case text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def case_parts(run: Column | str) -> Column:
    """An alphanumeric run's case parts: AddPDFPage2 -> Add, PDF, Page, 2."""
    return F.regexp_extract_all(_col(run), F.lit(CASE_PARTS), F.lit(0))


def without_stopwords(tokens: Column | str) -> Column:
    """Tokens that are no function words; order and repeats stay."""
    return F.filter(_col(tokens), lambda t: ~t.isin(*STOPWORDS))


def tokens(text: Column | str) -> Column:
    """The index tokens: plain tokens, then the lower-case case parts of every run that has more than one; without function
    words. A null text has null tokens."""
    runs = F.regexp_extract_all(_col(text), F.lit("[A-Za-z0-9]+"), F.lit(0))
    mixed = F.filter(runs, lambda r: F.regexp_like(r, F.lit("[a-zA-Z][0-9]|[0-9][a-zA-Z]|.[A-Z]")))
    parts = F.filter(F.transform(mixed, case_parts), lambda p: F.size(p) > 1)
    return without_stopwords(F.concat(plain_tokens(text), F.transform(F.flatten(parts), F.lower)))


def stem(word: Column | str) -> Column:
    """A light stemmer: the first rule that fits of ations, ation, ings, ing, ies, es, s, ed."""
    w = F.trim(F.lower(_col(word)))
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return (
        F.when(w.endswith("ations") & (n > 6), cut(6))
        .when(w.endswith("ation") & (n > 5), cut(5))
        .when(w.endswith("ings") & (n >= 7), cut(4))
        .when(w.endswith("ing") & (n >= 6), cut(3))
        .when(w.endswith("ies") & (n > 3), F.concat(cut(3), F.lit("y")))
        .when(F.regexp_like(w, F.lit("(?:s|x|z|ch|sh)es$")), cut(2))
        .when((n > 3) & w.endswith("s") & ~w.endswith("ss"), cut(1))
        .when((n > 4) & w.endswith("ed"), cut(2))
        .otherwise(w)
    )


def canon(word: Column | str) -> Column:
    """The key under which a word's forms meet: irregular stem or stem, then no -ly and no final e."""
    w = F.lower(_col(word))
    base = stem(word)
    for irregular, stem_of in IRREGULAR.items():
        base = F.when(w == irregular, F.lit(stem_of)).otherwise(base)
    cut = lambda x, n: F.substring(x, F.lit(1), F.length(x) - n)
    plain = let(base, lambda x: F.when((F.length(x) > 5) & x.endswith("ly"), cut(x, 2)).otherwise(x))
    return let(plain, lambda x: F.when((F.length(x) > 3) & x.endswith("e"), cut(x, 1)).otherwise(x))


def strip_zero_width(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), ZERO_WIDTH, "")


def plain_forms(query: Column | str) -> Column:
    """Plural acronyms without their s, words without a possessive 's."""
    return F.regexp_replace(F.regexp_replace(_col(query), r"\b([A-Z]{2,})s\b", "$1"), r"(?i)(?<=\w)['’]s\b", "")


def or_else(found: Column, fallback: Column) -> Column:
    """found, but the fallback where found is empty."""
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def stemmed_terms(query: Column | str, conversational: tuple[str, ...] = ()) -> Column:
    """A query's different stems, without conversational words and single letters; neither may empty the query."""
    all_tokens = tokens(plain_forms(strip_zero_width(query)))
    kept = or_else(F.filter(all_tokens, lambda t: ~F.array_contains(_strings(conversational), t)), all_tokens) if conversational else all_tokens
    stems = F.array_distinct(F.transform(kept, stem))
    return or_else(F.filter(stems, lambda t: ~F.regexp_like(t, F.lit("^[a-z]$"))), stems)


def excluded_terms(family: str, platform: str | None = None, extra: tuple[str, ...] = ()) -> Column:
    """Stems that name the scope rather than a task."""
    words = [*GENERIC, family, *([platform] if platform else []), *extra]
    return F.array_distinct(F.flatten(F.array(*[F.array_append(F.transform(tokens(F.lit(w)), stem), stem(F.lit(w))) for w in words])))


def query_terms(query: Column | str, excluded: Column) -> Column:
    """Stems minus the excluded ones, or all stems where nothing would be left."""
    terms = stemmed_terms(query)
    return or_else(F.array_except(terms, excluded), terms)


def distinctive_terms(query: Column | str, excluded: Column) -> Column:
    """Stems minus the excluded ones; may be empty."""
    return F.array_except(stemmed_terms(query), excluded)


def required_terms(query: Column | str) -> Column:
    """Stems of the identifier-like runs, which hold lower-then-upper case, an underscore, or lower case and a digit."""
    runs = F.regexp_extract_all(_col(query), F.lit("[A-Za-z0-9_]+"), F.lit(0))
    like = F.filter(runs, lambda r: F.regexp_like(r, F.lit("[a-z][A-Z]|_")) | (F.regexp_like(r, F.lit("[a-z]")) & F.regexp_like(r, F.lit("[0-9]"))))
    pieces = F.filter(F.flatten(F.transform(like, lambda r: F.split(r, "_"))), lambda p: p != "")
    return F.array_distinct(F.transform(pieces, stem))


def whole_name_key(name: Column | str) -> Column:
    return canon(F.regexp_replace(_col(name), "[^A-Za-z0-9]", ""))


def inflections(word: Column | str) -> Column:
    """A word and its simple inflected forms."""
    w = F.lower(_col(word))
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    none = F.array().cast("array<string>")
    return F.array_distinct(
        F.concat(
            F.array(w, F.concat(w, F.lit("s"))),
            F.when(w.endswith("ies") & (n > 3), F.array(F.concat(cut(3), F.lit("y")))).otherwise(none),
            F.when(w.endswith("es") & (n > 3), F.array(cut(2), cut(1))).when(w.endswith("s") & (n > 2), F.array(cut(1))).otherwise(none),
            F.when(w.endswith("ing") & (n > 5), F.array(cut(3), F.concat(cut(3), F.lit("e")))).otherwise(none),
            F.when(w.endswith("ed") & (n > 4), F.array(cut(2), cut(1))).otherwise(none),
        )
    )


def symbol_words(name: Column | str) -> Column:
    """The lower-case words of a name, cut at case changes and at blanks, dots, colons and underscores; a number before a
    capital unit goes with the unit (Texture2D -> texture, 2d)."""
    cut = F.regexp_replace(_col(name), r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ")
    cut = F.regexp_replace(cut, r"([0-9]+) (?=[A-Z](?![A-Za-z0-9])|[A-Z]{2} )", " $1")
    return F.filter(F.transform(F.split(cut, r"[\s._:]+"), F.lower), lambda w: w != "")


def code_hash(code: Column | str) -> Column:
    """sha256 of code with its white space normalised: no blanks at line ends, no blank lines at the edges."""
    lines = F.transform(F.split(F.regexp_replace(_col(code), "\r\n?", "\n"), "\n"), lambda x: F.rtrim(x, F.lit(" \t\x0b\x0c")))
    return F.sha2(F.regexp_replace(F.array_join(lines, "\n"), "^\n+|\n+$", ""), 256)


def content_id(title: Column | str, text: Column | str) -> Column:
    """Sixteen hexadecimal digits that name a section by its content."""
    return F.substring(F.sha2(F.concat(F.coalesce(_col(title), F.lit("")), F.lit("\x1f"), F.coalesce(_col(text), F.lit(""))), 256), 1, 16)


def one_line(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"[\x00-\x1f\x7f]+", " "))


def sanitized(text: Column | str, most: int = 24_000) -> Column:
    """Without invisible code points, cut at the last line end within `most` characters."""
    clean = F.regexp_replace(_col(text), "[\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\uFEFF\\u00AD]", "")
    head = F.substring(clean, 1, most)
    at = F.length(head) - F.locate("\n", F.reverse(head)) + 1
    cut = F.when(F.locate("\n", head) > 0, F.substring(head, F.lit(1), at - 1)).otherwise(head)
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(cut, F.lit("\n[truncated]")))


def query_shape(query: Column | str) -> Column:
    """empty, phrase, exact_fqn or keyword."""
    q = F.trim(F.coalesce(_col(query), F.lit("")))
    return F.when(q == "", "empty").when(q.contains(" "), "phrase").when(q.contains(".") | F.regexp_like(q, F.lit(r"^\p{Lu}")), "exact_fqn").otherwise("keyword")


def has_minimum_evidence(query: Column | str) -> Column:
    """Whether a query holds a run of two letters or digits, or C++ or C#."""
    return F.regexp_like(_col(query), F.lit(r"(?i)[a-z0-9]{2}|\bc(?:\+\+|#)"))


def neutralised(text: Column | str, known: Column) -> Column:
    """Code spans outside fences that are not in `known` lose their backticks."""
    fence = lambda line: F.regexp_like(line, F.lit(r"^[ \t]{0,3}(?:`{3,}|~{3,})"))

    def step(state: Column, line: Column) -> Column:
        inside = F.when(fence(line), ~state["inside"]).otherwise(state["inside"])
        spans = F.split(line, "`")
        fixed = F.array_join(F.transform(spans, lambda s, i: F.when((i % 2 == 1) & (i < F.size(spans) - 1) & F.array_contains(known, s), F.concat(F.lit("`"), s, F.lit("`"))).otherwise(s)), "")
        return F.struct(inside.alias("inside"), F.array_append(state["out"], F.when(state["inside"] | fence(line), line).otherwise(fixed)).alias("out"))

    first = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(F.split(_col(text), "\n"), first, step)["out"], "\n")
