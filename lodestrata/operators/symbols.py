"""Names: tiers, suffixes, members, identity, suggestions, evidence."""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import grammar, relevance
from lodestrata.functions import text as T
from lodestrata.functions.binding import let

PREFIX_LEAST = 3
ASKED_MOST = 1000


def match_tier(query: Column, name: Column, words: Column | None = None) -> Column:
    """0: the whole name; 1: its last segment; 2: a run of its words; 3: a run in which words of three letters or more may be
    prefixes, or a start of the last segment; null: no match. words: the name's words, where they are worked out already."""
    needle, full = F.lower(F.trim(query)), F.lower(F.trim(name))
    alike = lambda q, w: (q == w) | ((F.length(q) >= PREFIX_LEAST) & F.startswith(w, q))

    def by_words(wanted: Column, own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(own) - F.size(wanted) + 1)
        fits = (F.size(wanted) > 0) & (F.size(own) >= F.size(wanted))
        run = F.exists(starts, lambda i: F.slice(own, i, F.size(wanted)) == wanted)
        prefix = F.exists(starts, lambda i: F.forall(F.zip_with(wanted, F.slice(own, i, F.size(wanted)), alike), lambda ok: ok))
        return F.when(fits, F.when(run, 2).when(prefix, 3))

    stub = (F.length(needle) >= PREFIX_LEAST) & ~F.regexp_like(needle, F.lit(r"\s")) & F.startswith(grammar.last_segment(full), needle)
    found = let(T.symbol_words(query), lambda wanted: let(T.symbol_words(name) if words is None else words, lambda own: by_words(wanted, own)))
    return F.when(name.isNull() | (needle == ""), None).when(needle == full, 0).when(needle == grammar.last_segment(full), 1).otherwise(F.coalesce(found, F.when(stub, 3)))


def resolve(names: DataFrame, asked: DataFrame, name: str = "fqn", query: str = "query") -> DataFrame:
    """query, found, reason, name: the exact name, else the only one that ends with the query at a segment; several are a
    stated miss. An equi-join on exploded suffixes, not a scan for each query."""
    tails = names.select(F.col(name), F.explode(grammar.suffixes(F.lower(name))).alias("tail"))
    hits = asked.select(F.col(query), F.lower(query).alias("tail")).distinct().join(tails, "tail", "left")
    own = hits.groupBy(query).agg(F.count(name).alias("n"), F.max(F.when(F.lower(name) == F.col("tail"), F.col(name))).alias("exact"), F.min(name).alias("one"))
    found = F.coalesce("exact", F.when(F.col("n") == 1, F.col("one")))
    reason = F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("not_found")
    return own.select(query, found.isNotNull().alias("found"), reason.alias("reason"), found.alias(name))


def unique_names(entries: DataFrame, name: str, qualifier: str, order: str) -> DataFrame:
    """entries with a column unique: the name, qualified where several share it, numbered where that is not enough."""
    own = Window.partitionBy(name)
    step = entries.withColumn("_q", F.when(F.count("*").over(own) > 1, F.concat_ws(".", F.col(qualifier), F.col(name))).otherwise(F.col(name)))
    nth = F.row_number().over(Window.partitionBy("_q").orderBy(order))
    many = F.count("*").over(Window.partitionBy("_q")) > 1
    return step.withColumn("unique", F.when(many, F.concat(F.col("_q"), F.lit("#"), nth.cast("string"))).otherwise(F.col("_q"))).drop("_q")


def slot_cap(entries: DataFrame, unit: str, order: str, most: int) -> DataFrame:
    """Rows of the first `most` different units, by where each first stands."""
    first = entries.groupBy(unit).agg(F.min(order).alias("_first")).orderBy("_first", unit).limit(most)
    return entries.join(first.select(unit), unit, "left_semi")


def collapse_aliases(found: DataFrame, group: list[str], exact: Column, definition: Column, name: str, order: str) -> DataFrame:
    """One row of each group: an exact hit, else the definition, else the first; the others' names become aliases."""
    best = Window.partitionBy(*group).orderBy(F.when(exact, 0).when(definition, 1).otherwise(2), order)
    ranked = found.withColumn("_n", F.row_number().over(best))
    names = F.array_sort(F.collect_set(F.when(F.col("_n") > 1, F.col(name))))
    return ranked.groupBy(*group).agg(F.min(F.when(F.col("_n") == 1, F.col(name))).alias(name), names.alias("aliases"))


def member_index(members: DataFrame, owner: str = "owner", member: str = "member") -> DataFrame:
    """name -> the Owner.member spellings it may mean."""
    return members.groupBy(F.lower(member).alias("name")).agg(F.array_sort(F.collect_set(F.concat_ws(".", owner, member))).alias("owners"))


def suggestions(queries: DataFrame, names: DataFrame, query: str = "query", name: str = "fqn", n: int = 5, cutoff: float = 0.6) -> DataFrame:
    """query, suggestions: the n closest names by the sequence matcher's ratio, which no edit distance replaces; of equally close
    ones the last in order. Every name is compared, where it is; each task sends the n best of each query. queries: a stated
    set of at most ASKED_MOST."""
    asked = [r[0] for r in queries.select(query).distinct().limit(ASKED_MOST + 1).collect()]
    if len(asked) > ASKED_MOST:
        raise ValueError(f"ask for at most {ASKED_MOST} queries at a time")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[str, list[tuple[float, str, str]]] = {q: [] for q in asked if q}
        for batch in batches:
            known: dict[str, str] = {}
            for x in batch[name]:
                known[x.casefold()] = min(x, known.get(x.casefold(), x))
            for q, held in best.items():
                matcher = difflib.SequenceMatcher()
                matcher.set_seq2(q.casefold())
                for folded, own in known.items():
                    matcher.set_seq1(folded)
                    if matcher.real_quick_ratio() >= cutoff and matcher.quick_ratio() >= cutoff and matcher.ratio() >= cutoff:
                        held.append((matcher.ratio(), folded, own))
                merged: dict[str, tuple[float, str, str]] = {}
                for hit in held:
                    merged[hit[1]] = min(hit, merged.get(hit[1], hit))
                best[q] = heapq.nlargest(n, merged.values(), key=lambda hit: hit[:2])
        rows = [(q, *hit) for q, held in best.items() for hit in held]
        yield pd.DataFrame(rows, columns=["asked", "ratio", "folded", "own"])

    hits = names.select(name).where(F.col(name).isNotNull()).distinct().mapInPandas(close, "asked string, ratio double, folded string, own string")
    once = hits.groupBy("asked", "folded").agg(F.max("ratio").alias("ratio"), F.min("own").alias("own"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("ratio"), F.desc("folded")))).where(F.col("rank") <= n)
    listed = ranked.groupBy(F.col("asked").alias(query)).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "own"))), lambda x: x["own"]).alias("suggestions"))
    return queries.select(query).join(listed, query, "left").select(query, F.coalesce("suggestions", F.array().cast("array<string>")).alias("suggestions"))


def evidence_terms(queries: DataFrame, family: str, synonyms: DataFrame | None = None, key: str = "query_id", text: str = "query", conversational: tuple[str, ...] = ()) -> DataFrame:
    """key, place, concept, word, forms, light, family_stem: the words by which a task's types are found, in order, each concept
    once. A concept is a word's canonical key; forms are all keys that count as the same word.

    Runs of letters and digits are words, and so are the parts of mixed ones. Single letters, function words, conversational
    words and filler are none. Light ones help and need not be shown: verbs of requests, and words that only stem like the
    family's. The family's own and the generic words come in only where nothing else is left; where all that is left is
    light, the family's stems are not. synonyms: word, value, from a user's word to the words of an interface, one way; those
    of relevance.SYNONYMS go both ways."""
    runs = F.regexp_extract_all(T.plain_forms(T.strip_zero_width(F.coalesce(F.col(text), F.lit("")))), F.lit("[A-Za-z0-9]+"), F.lit(0))
    whole = lambda r: F.when(F.size(T.case_parts(r)) > 1, F.concat(F.array(r), T.case_parts(r))).otherwise(F.array(r))
    said = queries.select(key, F.posexplode(F.flatten(F.transform(runs, whole))).alias("place", "word")).withColumn("word", F.lower("word"))
    said = said.where(~F.regexp_like("word", F.lit("^[a-z]$")) & ~F.col("word").isin(*T.STOPWORDS, *conversational, *relevance.FILLER))
    once = said.withColumn("concept", T.canon("word")).groupBy(key, "concept").agg(F.min(F.struct("place", "word")).alias("first")).select(key, "concept", "first.*")
    held = once.withColumn("forms", F.array_union(F.array("concept"), relevance.stands_for("concept", _canonical)))
    if synonyms is not None:
        values = synonyms.where("word IS NOT NULL AND value IS NOT NULL").select(F.lower("word").alias("own"), T.canon("word").alias("same"), T.canon("value").alias("value"))
        by = lambda c: values.groupBy(F.col(c).alias("k")).agg(F.collect_set("value").alias("more"))
        for mine, theirs in (("concept", "same"), ("word", "own")):
            held = held.join(by(theirs), F.col(mine) == F.col("k"), "left").withColumn("forms", F.array_union("forms", F.coalesce("more", F.array().cast("array<string>")))).drop("k", "more")
    verbs = sorted({_canonical(w) for w in (*relevance.ACTIONS, *relevance.WEAK)})
    own = F.array_contains(T.tokens(F.lit(family)), F.col("word")) | (F.col("word") == family.lower())
    stems = F.transform(F.array(*map(F.lit, T.GENERIC)), T.stem)
    named = F.array_contains(T.excluded_terms(family), T.stem("word"))
    generic = own | (named & F.array_contains(stems, T.stem("word")))
    held = held.withColumn("common", generic).withColumn("family_stem", named & ~generic).withColumn("light", F.col("concept").isin(verbs) | F.col("family_stem"))
    of = Window.partitionBy(key)
    rest = held.withColumn("kept", F.sum((~F.col("common")).cast("int")).over(of)).where(~F.col("common") | (F.col("kept") == 0))
    strong = F.max(~F.col("light")).over(of)
    rest = rest.withColumn("light", F.col("light") & (strong | (F.col("kept") == 0) | ~F.col("family_stem")))
    return rest.select(key, "place", "concept", "word", F.array_sort("forms").alias("forms"), "light", "family_stem")


def _canonical(word: str) -> str:
    """text.canon for the words of the fixed lists, none of which has an irregular stem or one of text.stem's endings."""
    return word[:-1] if len(word) > 3 and word.endswith("e") else word


def evidence(entries: DataFrame, concepts: DataFrame) -> DataFrame:
    """Ranks entries (entry, word, place: type or member) by the concepts (concept, word, weight, light) that they show.

    A concept counts its weight times 2.0 in a type's name, 1.5 in a member's, and 0.5 more in both; light ones 0.5. Entries
    that show less than 60 % of the weight are left out."""
    total = concepts.select("concept", "weight").distinct().agg(F.sum("weight").alias("total"))
    hit = entries.join(concepts, "word").groupBy("entry", "concept").agg(F.max((F.col("place") == "type").cast("int")).alias("t"), F.max((F.col("place") == "member").cast("int")).alias("m"), F.first("weight").alias("weight"), F.max("light").alias("light"))
    worth = F.when(F.col("light"), F.lit(0.5)).otherwise(F.when(F.col("t") == 1, F.lit(2.0)).otherwise(F.lit(1.5)) + F.when((F.col("t") == 1) & (F.col("m") == 1), F.lit(0.5)).otherwise(F.lit(0.0)))
    scored = hit.groupBy("entry").agg(F.sum(F.col("weight") * worth).alias("score"), F.sum("weight").alias("held"))
    return scored.crossJoin(F.broadcast(total)).where(F.col("held") >= 0.6 * F.col("total")).select("entry", F.round("score", 6).alias("score"))


def called_members(examples: DataFrame, members: DataFrame, key: str = "example_id", code: str = "code") -> DataFrame:
    """key, member, owner: the member accesses in code that a known owner declares."""
    calls = examples.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(code), F.lit(r"(?:\.|->|::)\s*([A-Za-z_]\w*)"), F.lit(1)))).alias("member"))
    return calls.join(members.select("owner", "member").distinct(), "member")


def async_twins(members: DataFrame) -> DataFrame:
    """Members whose Async form stands beside them."""
    other = members.select("owner", F.regexp_replace("member", "Async$", "").alias("member")).where(F.col("member") != "").distinct()
    return members.where(~F.col("member").endswith("Async")).join(other, ["owner", "member"], "left_semi")
