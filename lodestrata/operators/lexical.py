"""Keyword retrieval: postings, statistics, BM25, weighted coverage, passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.binding import let

K1, B = 1.5, 0.75
FLOOR, KNOWN_CEILING, CEILING = 0.5, 1.0, 2.0
PASSAGE_LINES = 10
UBIQUITY, UBIQUITY_LEAST = 0.12, 20


def tokenised(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, tokens and dl; a null text has no tokens."""
    listed = docs.select(F.col(key), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"))
    return listed.withColumn("dl", F.size("tokens"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and token: key, dl, token, tf. One shuffle, pre-aggregated on the map side."""
    return tokenised(docs, key, text).select(key, "dl", F.explode("tokens").alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def doc_freq(posted: DataFrame) -> DataFrame:
    return posted.groupBy("token").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: n_docs and avgdl over all documents, empty ones too; 1.0 where it would not be positive."""
    size = F.size(T.tokens(F.coalesce(F.col(text), F.lit(""))))
    stats = docs.select(size.alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    return stats.select("n_docs", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(F.lit(1.0)).alias("avgdl"))


def query_tokens(queries: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, times: repeats of a token in a query count again."""
    return queries.select(key, F.explode(T.tokens(F.coalesce(F.col(text), F.lit("")))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("times"))


def bm25(docs: DataFrame, queries: DataFrame, query_key: str, query_text: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (query_key, key, score) with a positive score.

    Only postings of query tokens survive the first join, and their document frequencies come from a window over what is
    left, so the corpus is tokenised once for the postings and once, without a shuffle, for the statistics."""
    asked = query_tokens(queries, query_key, query_text)
    hit = tokenised(docs, key, text).select(key, "dl", F.explode("tokens").alias("token")).join(asked.select("token").distinct(), "token", "left_semi")
    counted = hit.groupBy(key, "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = counted.groupBy("token").agg(F.count("*").alias("df"))
    stats = F.broadcast(corpus_stats(docs, text))  # one row
    weighed = asked.join(df, "token").crossJoin(stats)
    weighed = weighed.withColumn("idf", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1))
    gain = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return counted.join(weighed, "token").groupBy(query_key, key).agg(F.sum(gain).alias("score")).where("score > 0")


def tf_idf(docs: DataFrame, queries: DataFrame, query_key: str, query_text: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The plain variant over plain tokens: (tf / dl) * (ln((N + 1) / (df + 1)) + 1)."""
    plain = lambda df, k, t: df.select(F.col(k), T.plain_tokens(F.coalesce(F.col(t), F.lit(""))).alias("tokens"))
    asked = plain(queries, query_key, query_text).select(query_key, F.explode("tokens").alias("token")).groupBy(query_key, "token").agg(F.count("*").alias("times"))
    listed = plain(docs, key, text).withColumn("dl", F.size("tokens"))
    counted = listed.select(key, "dl", F.explode("tokens").alias("token")).join(asked.select("token").distinct(), "token", "left_semi").groupBy(key, "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = counted.groupBy("token").agg(F.count("*").alias("df"))
    total = F.broadcast(docs.agg(F.count("*").alias("n_docs")))
    weighed = asked.join(df, "token").crossJoin(total).withColumn("idf", F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1)
    return counted.join(weighed, "token").groupBy(query_key, key).agg(F.sum(F.col("times") * F.col("tf") / F.col("dl") * F.col("idf")).alias("score"))


def top_k(scored: DataFrame, by: str, k: int, key: str = "doc_id", digits: int = 6) -> DataFrame:
    """The k best of each `by`: score rounded, then the smaller key."""
    best = Window.partitionBy(by).orderBy(F.desc("score"), key)
    return scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def stem_freq(posted: DataFrame) -> DataFrame:
    """stem, df: the sum of the document frequencies of the tokens with this stem; may exceed the number of documents."""
    return doc_freq(posted).groupBy(T.stem("token").alias("stem")).agg(F.sum("df").alias("df"))


def idf_weight(df: Column, n_docs: Column) -> Column:
    """2.0 for a term nobody has, else ln(1 + N / (1 + df)) within 0.5 and 1.0."""
    return F.when(F.coalesce(df, F.lit(0)) == 0, F.lit(CEILING)).otherwise(F.greatest(F.lit(FLOOR), F.least(F.lit(KNOWN_CEILING), F.log(1 + n_docs / (1 + df)))))


def ubiquitous(posted: DataFrame, n_docs: Column | int, fraction: float = UBIQUITY, least: int = UBIQUITY_LEAST) -> DataFrame:
    """Stems in at least a fraction of the documents, where there are enough of them."""
    stems = posted.select("doc_id", T.stem("token").alias("stem")).distinct().groupBy("stem").agg(F.count("*").alias("df"))
    n = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    return stems.where((n >= least) & (F.col("df") / n >= fraction))


def weighted_terms(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """terms (query, term) with weights from the documents: query, term, weight."""
    stems = tokenised(docs, key, text).select(F.explode(F.array_distinct("tokens")).alias("token")).select(T.stem("token").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    df = stems.groupBy("term").agg(F.count("*").alias("df"))
    total = F.broadcast(docs.agg(F.count("*").alias("n_docs")))
    return terms.join(df, "term", "left").crossJoin(total).select(*terms.columns, idf_weight(F.col("df"), F.col("n_docs")).alias("weight"))


def coverage(docs: DataFrame, weighted: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """query, key, coverage, n_present for documents that hold a term: the weight of its terms over the weight of all."""
    stems = tokenised(docs, key, text).select(key, F.explode(F.array_distinct(F.transform("tokens", T.stem))).alias("term"))
    total = weighted.groupBy(query).agg(F.sum("weight").alias("total"))
    present = stems.join(weighted, "term").groupBy(query, key).agg(F.sum("weight").alias("held"), F.count("*").alias("n_present"))
    return present.join(total, query).select(query, key, F.when(F.col("total") > 0, F.col("held") / F.col("total")).otherwise(F.lit(0.0)).alias("coverage"), "n_present")


def guarded(covered: DataFrame, docs: DataFrame, required: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """coverage, but 0 where a required term (query, term) is not in the document."""
    need = required.groupBy(query).agg(F.count("*").alias("needed"))
    stems = tokenised(docs, key, text).select(key, F.explode(F.array_distinct(F.transform("tokens", T.stem))).alias("term"))
    has = stems.join(required, "term").groupBy(query, key).agg(F.count("*").alias("has"))
    joined = covered.join(need, query, "left").join(has, [query, key], "left")
    return joined.select(query, key, F.when(F.coalesce("needed", F.lit(0)) <= F.coalesce("has", F.lit(0)), F.col("coverage")).otherwise(F.lit(0.0)).alias("coverage"), "n_present")


def passage_lines(text: Column) -> Column:
    """The stems of each line; to be a column of its own, as best_passage reads it for every run of lines."""
    return F.transform(F.split(text, "\n"), lambda line: F.transform(T.tokens(line), T.stem))


def best_passage(own: Column, terms: Column, weights: Column, title_terms: Column | None = None, lines: int = PASSAGE_LINES) -> Column:
    """The best coverage of terms (with their weights) over all runs of `lines` of the passage lines; title terms count in each.

    One walk over the lines: each term keeps the last line that holds it, and counts as long as that is within the run that
    ends at the present line. Runs at the start that are shorter hold no more than the first whole one."""
    title = title_terms if title_terms is not None else F.array().cast("array<string>")
    never = -(1 << 30)

    def step(state: Column, line: Column) -> Column:
        last = F.transform(terms, lambda t, k: F.when(F.array_contains(line, t), state["at"]).otherwise(F.get(state["last"], k)))

        def scored(now: Column) -> Column:
            held = F.transform(terms, lambda t, k: F.when((F.get(now, k) > state["at"] - lines) | F.array_contains(title, t), F.get(weights, k)).otherwise(F.lit(0.0)))
            score = F.aggregate(held, F.lit(0.0), lambda a, b: a + b)
            return F.struct(now.alias("last"), (state["at"] + 1).alias("at"), F.greatest(state["best"], score).alias("best"))

        return let(last, scored)

    first = F.struct(F.transform(terms, lambda t: F.lit(never)).alias("last"), F.lit(0).alias("at"), F.lit(0.0).alias("best"))
    total = F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    return F.when(total > 0, F.aggregate(own, first, step)["best"] / total).otherwise(F.lit(0.0))
