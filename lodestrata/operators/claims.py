"""Claims and citations: anchors, numbers, formats, defects, contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANCHOR = r"\A[A-Za-z_](?:[A-Za-z0-9_.]|::)*+\z"
SEVERITY = ("supported", "insufficient_evidence", "partially_supported", "unsupported", "contradicted")


def anchors(text: Column | str) -> Column:
    """The inline code spans that look like names, without a call's parentheses. Digits may follow a dot: versions are cited too."""
    t = F.col(text) if isinstance(text, str) else text
    spans = F.transform(F.regexp_extract_all(t, F.lit(r"`([^`\n]+)`"), F.lit(1)), called)
    return F.filter(spans, lambda s: F.regexp_like(s, F.lit(ANCHOR)))


def called(span: Column) -> Column:
    """What a code span calls: without its last parentheses."""
    return F.btrim(F.regexp_replace(F.btrim(span), r"\(.*\)\z", ""))


def resolved(asked: DataFrame, declared: DataFrame, anchor: str = "anchor") -> DataFrame:
    """anchor, n, verdict: supported by exactly one declaration; a bare name by the only one that ends in it."""
    n = declared.groupBy(anchor).agg(F.count("*").alias("n"))
    tails = declared.select(F.element_at(F.split(anchor, r"\.|::"), -1).alias("tail"), F.col(anchor).alias("whole")).where("tail <> whole").groupBy("tail").agg(F.count("*").alias("by_tail"))
    joined = asked.select(anchor).distinct().join(n, anchor, "left").join(tails.withColumnRenamed("tail", anchor), anchor, "left")
    count = F.coalesce("n", "by_tail", F.lit(0))
    return joined.select(anchor, count.alias("n"), F.when(count == 1, "supported").when(count > 1, "partially_supported").otherwise("unsupported").alias("verdict"))


def numeric_claims(text: Column | str, units: tuple[str, ...]) -> Column:
    """Structs (number, unit) of `1,234 classes` and the like."""
    t = F.col(text) if isinstance(text, str) else text
    pattern = F.lit(rf"(?i)\b(\d[\d,]*)\s+({'|'.join(units)})\b")
    zipped = F.arrays_zip(F.regexp_extract_all(t, pattern, F.lit(1)).alias("number"), F.regexp_extract_all(t, pattern, F.lit(2)).alias("unit"))
    return F.transform(zipped, lambda z: F.struct(F.regexp_replace(z["number"], ",", "").try_cast("long").alias("number"), F.lower(z["unit"]).alias("unit")))


def checked_numbers(claims: DataFrame, known: DataFrame) -> DataFrame:
    """claims (number, unit, ...) with a verdict by the known counts (unit, known)."""
    joined = claims.join(known, "unit", "left")
    return joined.withColumn("verdict", F.when(F.col("known").isNull(), "insufficient_evidence").when(F.col("known") == F.col("number"), "supported").otherwise("unsupported"))


def worst(verdicts: DataFrame, key: str) -> DataFrame:
    """key, verdict, detail: of each key the gravest verdict and the first detail that has it."""
    rank = F.array_position(F.lit(list(SEVERITY)), F.col("verdict"))
    return verdicts.groupBy(key).agg(F.max_by("verdict", rank).alias("verdict"), F.min_by("detail", F.struct(-rank, "ord")).alias("detail"))


def unmatched_claims(claims: DataFrame, enums: DataFrame) -> DataFrame:
    """claims (scope, direction, format) that no member of the scope's enum has; scopes without an enum say nothing. A claim of
    no direction is held against all of the scope's members."""
    known = claims.join(enums.select("scope").distinct(), "scope", "left_semi")
    directed = known.where("direction is not null").join(enums, ["scope", "direction", "format"], "left_anti")
    open_ = known.where("direction is null").join(enums, ["scope", "format"], "left_anti")
    return directed.unionByName(open_)


def applicable_defects(symbols: DataFrame, defects: DataFrame) -> DataFrame:
    """name, defect_id: defects (defect_id, refs, indexed_commit) that name a symbol (name, aliases, commit) or an alias of it;
    those of one commit only where it is the symbol's. A name is met by the set of a reference's defects, not by each of them:
    no more than the answer's rows come to be."""
    named = symbols.select("name", "commit", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("ref"))
    refs = defects.select("defect_id", "indexed_commit", F.explode("refs").alias("ref"))
    every = refs.where("indexed_commit is null").groupBy("ref").agg(F.collect_set(F.struct("defect_id")).alias("every"))
    some = refs.where("indexed_commit is not null").groupBy("ref", F.col("indexed_commit").alias("commit")).agg(F.collect_set(F.struct("defect_id")).alias("some"))
    none = F.array().cast(every.schema["every"].dataType)
    met = named.join(every, "ref", "left").join(some, ["ref", "commit"], "left").where("every is not null or some is not null")
    held = met.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("every", none), F.coalesce("some", none))))).alias("ids"))
    return held.select("name", F.explode("ids").alias("x")).select("name", "x.defect_id")


def format_contradictions(statements: DataFrame) -> DataFrame:
    """scope, format where one section says yes and another no (scope, section, format, positive)."""
    sides = statements.groupBy("scope", "format").agg(F.max(F.when(F.col("positive"), F.col("section"))).alias("yes"), F.max(F.when(~F.col("positive"), F.col("section"))).alias("no"))
    return sides.where("yes is not null and no is not null")


def stale_negatives(negatives: DataFrame, symbols: DataFrame) -> DataFrame:
    """Statements that an identifier is missing, of identifiers that are indexed."""
    return negatives.join(symbols.select(F.col("short").alias("identifier")).distinct(), "identifier", "left_semi")


def support_clauses(text: Column | str, formats: tuple[str, ...]) -> Column:
    """Clauses that claim support of a known format: a verb, no negation, a format's word."""
    t = F.col(text) if isinstance(text, str) else text
    clauses = F.filter(F.transform(F.split(t, r"[.;\n]|,\s*but\b"), lambda x: F.trim(x)), lambda c: c != "")
    claims = lambda c: F.regexp_like(c, F.lit(r"(?i)\b(?:supports?|reads?|writes?|loads?|saves?|converts?|exports?|imports?)\b")) & ~F.regexp_like(c, F.lit(r"(?i)\b(?:not|no|never|cannot|without)\b|n't\b")) & F.regexp_like(c, F.lit(rf"(?i)\b(?:{'|'.join(formats)})\b"))
    return F.filter(clauses, claims)


def unmarked(text: Column, unresolved: Column) -> Column:
    """text and n (a struct): code spans outside ``` fences whose anchor is in `unresolved` lose their backticks, and how many do."""
    piece = lambda x: F.when(F.length(x) > 2, F.when(F.array_contains(unresolved, called(F.btrim(x, F.lit("`")))) & x.startswith("`"), F.struct(F.btrim(x, F.lit("`")).alias("text"), F.lit(1).alias("n")))).otherwise(F.lit(None))
    kept = lambda x: F.coalesce(piece(x), F.struct(x.alias("text"), F.lit(0).alias("n")))
    cut = lambda line: F.transform(F.regexp_extract_all(line, F.lit(r"`[^`]+`|`|[^`]+"), F.lit(0)), kept)

    def step(state: Column, line: Column) -> Column:
        fence = F.regexp_like(line, F.lit(r"\A\s*```"))
        as_is = fence | state["inside"]
        return F.struct(
            (state["inside"] != fence).alias("inside"),
            F.array_append(state["lines"], F.when(as_is, line).otherwise(F.array_join(F.transform(cut(line), lambda x: x["text"]), ""))).alias("lines"),
            (state["n"] + F.when(as_is, 0).otherwise(F.aggregate(cut(line), F.lit(0), lambda n, x: n + x["n"]))).alias("n"),
        )

    first = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("lines"), F.lit(0).alias("n"))
    return F.aggregate(F.split(text, "\n", -1), first, step, lambda s: F.struct(F.array_join(s["lines"], "\n").alias("text"), s["n"].alias("n")))
