"""Queries over documents, pages and vectors."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions import grammar, predicates
from lodestrata.functions import text as T
from lodestrata.operators import budget, chunking, index, lexical, vectors

from . import oracle as O

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


TEXT = "coalesce(text, '')"
#: The flagship's query: common words of the tables' language, one with a repeat.
ASKED = "thentherea ofthouerre whed the onation onation reheat"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """BM25 top ten of one query over all documents."""
    asked = spark.createDataFrame([(0, ASKED)], "query_id int, query string")
    return lexical.top_k(index.of_generation(read(spark, d, "documents")).bm25(asked, "query_id", "query"), "query_id", 10).select("doc_id", "score", "rank")


BM25_SQL = """
    WITH d AS (SELECT doc_id, {tokens} AS ts FROM documents), s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
    p AS (SELECT doc_id, len(ts) AS dl, unnest(ts) AS token FROM d), c AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM p GROUP BY ALL),
    f AS (SELECT token, count(*) AS df FROM c GROUP BY token),
    q AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({asked}) AS token FROM ({source})) GROUP BY ALL),
    r AS (SELECT query_id, doc_id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
          FROM q JOIN c USING (token) JOIN f USING (token), s GROUP BY ALL)
    SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= {k}
"""


@query("SELECT doc_id, score, rank FROM (" + BM25_SQL.format(tokens=O.tokens(TEXT), asked=O.tokens("query"), source=f"SELECT 0 AS query_id, '{ASKED}' AS query", k=10) + ")")
def bm25_topk(spark, d):
    return flagship(spark, d)


@query(BM25_SQL.format(tokens=O.tokens(TEXT), asked=O.tokens("text"), source="SELECT item_id AS query_id, text FROM benchmark", k=5))
def bm25_batch(spark, d):
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.top_k(index.of_generation(read(spark, d, "documents")).bm25(asked, "query_id", "query"), "query_id", 5).select("query_id", "doc_id", "score", "rank")


@query(f"""
    WITH d AS (SELECT doc_id, {O.plain_tokens(TEXT)} AS ts FROM documents), n AS (SELECT count(*) AS n FROM d),
    c AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS token FROM d) GROUP BY ALL),
    f AS (SELECT token, count(*) AS df FROM c GROUP BY token),
    q AS (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest({O.plain_tokens("text")}) AS token FROM benchmark) GROUP BY ALL),
    r AS (SELECT query_id, doc_id, round(sum(times * tf / dl * (ln((n + 1) / (df + 1)) + 1)), 6) AS score FROM q JOIN c USING (token) JOIN f USING (token), n GROUP BY ALL)
    SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 5
""")
def tfidf_topk(spark, d):
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return lexical.top_k(index.of_generation(read(spark, d, "documents"), tokeniser="plain").tf_idf(asked, "query_id", "query"), "query_id", 5).select("query_id", "doc_id", "score", "rank")


@query(f"""
    SELECT doc_id, len(ts) AS n_tokens, len(list_distinct(ts)) AS n_distinct, md5(array_to_string(ts, ' ')) AS tokens_md5
    FROM (SELECT doc_id, {O.tokens(TEXT)} AS ts FROM documents)
""")
def tokenize_counts(spark, d):
    ts = read(spark, d, "documents").select("doc_id", T.tokens(F.coalesce("text", F.lit(""))).alias("ts"))
    return ts.select("doc_id", F.size("ts").alias("n_tokens"), F.size(F.array_distinct("ts")).alias("n_distinct"), F.md5(F.array_join("ts", " ")).alias("tokens_md5"))


@query(f"""
    SELECT lang, sum(len({O.plain_tokens(TEXT)}))::BIGINT AS n_all, sum(len(list_filter({O.plain_tokens(TEXT)}, lambda t: t NOT IN ({O.STOP}))))::BIGINT AS n_kept
    FROM documents GROUP BY lang
""")
def stopword_filter(spark, d):
    plain = T.plain_tokens(F.coalesce("text", F.lit("")))
    return read(spark, d, "documents").groupBy("lang").agg(F.sum(F.size(plain)).alias("n_all"), F.sum(F.size(T.without_stopwords(plain))).alias("n_kept"))


def parts(spark, d) -> DataFrame:
    """Parts under names made from their own words."""
    words = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), F.substring(w, 2, 1000))), "")
    kind = F.concat(F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring("p_type", 2, 1000)))
    return read(spark, d, "part").withColumn("name", F.concat_ws(".", kind, words, F.concat(F.lit("B"), F.regexp_extract("p_brand", "[0-9]+", 0))))


@query(f"""
    SELECT name, array_to_string({O.case_parts('replace(name, ' + chr(39) + '.' + chr(39) + ', ' + chr(39) + chr(39) + ')')}, ' ') AS parts, count(*) AS n
    FROM (SELECT {O.PART_NAME} AS name FROM part) GROUP BY ALL
""")
def camel_split(spark, d):
    return parts(spark, d).groupBy("name").agg(F.count("*").alias("n")).select("name", F.array_join(T.case_parts(F.replace(F.col("name"), F.lit("."), F.lit(""))), " ").alias("parts"), "n")


@query(f"""
    SELECT {O.stem('token')} AS stem, count(*) AS n, count(DISTINCT token) AS n_forms FROM (SELECT unnest({O.tokens(TEXT)}) AS token
    FROM documents) GROUP BY 1 HAVING count(*) >= 20
""")
def stem_counts(spark, d):
    ts = read(spark, d, "documents").select(F.explode(T.tokens(F.coalesce("text", F.lit("")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return ts.groupBy(T.stem("token").alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("n_forms")).where("n >= 20")


@query(f"""
    SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({O.tokens(TEXT)}) AS token FROM documents) GROUP BY token
    HAVING count(*) >= 5
""")
def doc_freq(spark, d):
    return index.of_generation(read(spark, d, "documents")).dictionary.where("df >= 5").select("token", "df")


@query(f"SELECT count(*) AS n_docs, round(avg(len({O.tokens(TEXT)})), 6) AS avgdl FROM documents")
def corpus_stats(spark, d):
    return index.of_generation(read(spark, d, "documents")).stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"""
    SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({O.tokens(TEXT)}) AS token FROM documents) GROUP BY ALL
    HAVING count(*) >= 8
""")
def term_freq(spark, d):
    return index.of_generation(read(spark, d, "documents")).postings.where("tf >= 8").select("doc_id", "token", "tf")


TERMS = f"t AS (SELECT item_id AS query_id, unnest({O.stemmed_terms('text')}) AS term FROM benchmark)"
STEMS = f"s AS (SELECT DISTINCT doc_id, {O.stem('token')} AS term FROM (SELECT doc_id, unnest({O.tokens(TEXT)}) AS token FROM documents))"
WEIGHTS = f"f AS (SELECT {O.stem('token')} AS term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({O.tokens(TEXT)}) AS token FROM documents) GROUP BY 1), w AS (SELECT query_id, term, CASE WHEN f.df IS NULL THEN 2.0 ELSE greatest(0.5, least(1.0, ln(1 + (SELECT count(*) FROM documents) / (1 + f.df)))) END AS weight FROM t LEFT JOIN f USING (term))"


def weighted(spark, d) -> tuple[index.KeywordIndex, DataFrame]:
    held = index.of_generation(read(spark, d, "documents"))
    terms = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.stemmed_terms("text")).alias("term"))
    return held, held.weights(terms)


@query(f"WITH {TERMS}, {WEIGHTS} SELECT query_id, term, round(weight, 6) AS weight FROM w")
def idf_weights(spark, d):
    return weighted(spark, d)[1].select("query_id", "term", F.round("weight", 6).alias("weight"))


COVERED = f"WITH {TERMS}, {WEIGHTS}, {STEMS}, z AS (SELECT query_id, sum(weight) AS total FROM w GROUP BY query_id), c AS (SELECT query_id, doc_id, round(sum(weight) / any_value(total), 6) AS coverage, count(*) AS n_present FROM w JOIN s USING (term) JOIN z USING (query_id) GROUP BY query_id, doc_id)"


@query(COVERED + " SELECT * FROM c WHERE coverage >= 0.5")
def weighted_coverage(spark, d):
    held, w = weighted(spark, d)
    return held.coverage(w, "query_id").withColumn("coverage", F.round("coverage", 6)).where("coverage >= 0.5")


@query(COVERED + " SELECT query_id, doc_id, coverage, n_present FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, doc_id) AS r FROM c WHERE coverage >= 0.41 AND coverage < 0.6 AND n_present >= 2 AND query_id IN (SELECT query_id FROM w GROUP BY query_id HAVING count(*) >= 6)) WHERE r <= 3")
def partial_tier(spark, d):
    held, w = weighted(spark, d)
    """Of queries of six terms or more, what holds two or more of them, but not enough to be relevant."""
    long = w.groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 6")
    c = held.coverage(w, "query_id").withColumn("coverage", F.round("coverage", 6)).where("coverage >= 0.41 and coverage < 0.6 and n_present >= 2").join(long, "query_id", "left_semi")
    best = Window.partitionBy("query_id").orderBy(F.desc("coverage"), "doc_id")
    return c.withColumn("r", F.row_number().over(best)).where("r <= 3").drop("r")


@query(f"""
    WITH q AS (SELECT p_partkey, {O.PART_NAME} AS name FROM part), r AS (SELECT p_partkey, unnest(regexp_extract_all(name, '[A-Za-z0-9_]+')) AS run FROM q)
    SELECT p_partkey, {O.stem('lower(run)')} AS term FROM r WHERE regexp_matches(run, '[a-z][A-Z]|_') OR (regexp_matches(run, '[a-z]') AND regexp_matches(run, '[0-9]'))
""")
def required_terms(spark, d):
    return parts(spark, d).select("p_partkey", F.explode(T.required_terms("name")).alias("term"))


REQUIRED = """
    , q AS (SELECT item_id AS query_id, unnest(list_distinct(list_transform(
        list_filter(regexp_extract_all(text || ' doc2vec', '[A-Za-z0-9_]+'),
                    lambda r: regexp_matches(r, '[a-z][A-Z]|_') OR (regexp_matches(r, '[a-z]') AND regexp_matches(r, '[0-9]'))),
        lambda r: lower(r)))) AS term FROM benchmark),
    m AS (SELECT c.query_id, c.doc_id FROM c JOIN q USING (query_id)
          WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc_id = c.doc_id AND s.term = q.term) GROUP BY ALL)
    SELECT query_id, doc_id, CASE WHEN m.doc_id IS NULL THEN coverage ELSE 0.0 END AS coverage
    FROM c LEFT JOIN m USING (query_id, doc_id) WHERE coverage >= 0.5
"""


@query(COVERED + REQUIRED)
def guarded_coverage(spark, d):
    held, w = weighted(spark, d)
    required = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.required_terms(F.concat("text", F.lit(" doc2vec")))).alias("term"))
    c = held.coverage(w, "query_id").withColumn("coverage", F.round("coverage", 6)).where("coverage >= 0.5")
    return held.guarded(c, required, "query_id").select("query_id", "doc_id", "coverage")


@query(f"""
    WITH p AS (SELECT doc_id, len(ts) AS dl, ts FROM (SELECT doc_id, {O.tokens(TEXT)} AS ts FROM documents)), e AS (SELECT DISTINCT doc_id, unnest(ts) AS token FROM p),
    x AS (SELECT DISTINCT doc_id, {O.stem('token')} AS stem FROM e)
    SELECT stem, count(*) AS df FROM x GROUP BY stem HAVING count(*) / (SELECT count(*) FROM documents) >= 0.12 AND (SELECT count(*) FROM documents) >= 20
""")
def ubiquitous_stems(spark, d):
    return index.of_generation(read(spark, d, "documents")).ubiquitous()


@query(f"""
    WITH l AS (SELECT doc_id, i, {O.tokens("line")} AS ts FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
    n AS (SELECT doc_id, max(i) AS n FROM l GROUP BY doc_id), a AS (SELECT doc_id, unnest(range(1, greatest(n - 9, 1) + 1)) AS start FROM n),
    h AS (SELECT a.doc_id, a.start, count(DISTINCT t) AS hit FROM a JOIN l ON l.doc_id = a.doc_id AND l.i BETWEEN a.start AND a.start + 9, (SELECT unnest(['of', 'hand', 'tion', 'ation', 'onat', 'ed']) AS t) q WHERE list_contains(list_transform(l.ts, lambda x: {O.stem('x')}), t) GROUP BY ALL)
    SELECT n.doc_id, coalesce(round(max(hit) / 6.0, 6), 0.0) AS coverage FROM n LEFT JOIN h USING (doc_id) GROUP BY n.doc_id
""")
def passage_windows(spark, d):
    terms = F.array(*map(F.lit, ("of", "hand", "tion", "ation", "onat", "ed")))
    docs = read(spark, d, "documents")
    lined = docs.select("doc_id", lexical.passage_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    return lined.select("doc_id", F.round(lexical.best_passage(F.col("lines"), terms, F.array_repeat(F.lit(1.0), 6)), 6).alias("coverage"))


@query(r"""
    SELECT doc_id, length(text) > 8000 OR (len(ls) > 0 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\s*(?:\||- +`[^`]+`\s*[-:–—])'))) >= 0.5 * len(ls)) AS is_table
    FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents WHERE text IS NOT NULL)
""")
def table_dominated(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", predicates.table_dominated("text").alias("is_table"))


@query(r"""
    SELECT doc_id, i - 1 AS part, trim(p) AS text FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\n\s*\n+'), lambda p: trim(p, E' \t\n\r') <> '') AS ps FROM documents))
""".replace("trim(p)", "trim(p, E' \\t\\n\\r')"))
def paragraph_sections(spark, d):
    return chunking.paragraphs(read(spark, d, "documents"))


def with_headings(docs: DataFrame) -> DataFrame:
    """doc_id, text: every document under a heading, before a fence that holds none, and before a last section."""
    tail = F.concat(F.lit("\n````py\n# no heading\n```\n````\n## Last ##\nin "), F.coalesce("lang", F.lit("none")))
    return docs.select("doc_id", F.concat(F.lit("# Document "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), tail).alias("text"))


@query()
def heading_sections(spark, d):
    """Checked against a plain version in the tests: SQL has no fold over lines."""
    found = chunking.sections(with_headings(read(spark, d, "documents")))
    return found.select("doc_id", "part", "title", F.md5("text").alias("text_md5"))


@query()
def fence_spans(spark, d):
    body = F.concat(F.lit("a\n````py\n```\n# x\n"), F.coalesce("text", F.lit("")), F.lit("\n````\nb"))
    lines = F.split(body, "\n")
    return read(spark, d, "documents").select("doc_id", F.size(F.filter(chunking.fenced(lines), lambda x: x)).alias("n_fenced"), F.size(lines).alias("n_lines"))


@query()
def oversize_split(spark, d):
    return chunking.oversize_parts(read(spark, d, "documents"), most=2000).select("doc_id", "part", "parts", F.length("text").alias("n_chars"))


@query()
def part_numbering(spark, d):
    return chunking.chunks(read(spark, d, "documents")).select("doc_id", "part", "parts", F.md5("text").alias("text_md5"))


@query("""
    SELECT doc_id, left(sha256(coalesce(source, '') || chr(31) || coalesce(text, '')),
    16) AS chunk_id, concat_ws('::', 'g1', 'doc', left(sha256(coalesce(source, '') || chr(31) || coalesce(text, '')), 16)) AS doc_key
    FROM documents
""")
def content_chunk_id(spark, d):
    key = T.content_id("source", "text")
    return read(spark, d, "documents").select("doc_id", key.alias("chunk_id"), F.concat_ws("::", F.lit("g1"), F.lit("doc"), key).alias("doc_key"))


@query("""
    SELECT doc_id, md5(CASE WHEN length(text) <= 3000 THEN text ELSE (CASE WHEN strpos(left(text, 3000),
    chr(10)) > 0 THEN regexp_replace(left(text, 3000), '(?s)\\n[^\\n]*$', '')
    ELSE left(text, 3000) END) || chr(10) || '[truncated]' END) AS text_md5 FROM documents WHERE text IS NOT NULL
""")
def sanitize_text(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.sanitized("text", 3000)).alias("text_md5"))


@query("""
    WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN coalesce(text, '')
        ELSE 'FQN: Doc: ' || coalesce(lang, '') || CASE doc_id % 4 WHEN 1 THEN ' Environment setup' WHEN 2 THEN ' Unsupported input' ELSE ' Page Setup and more' END
             || chr(10) || CASE WHEN doc_id % 5 = 0 THEN 'FAQ: ' ELSE '' END || coalesce(text, '') END AS t FROM documents)
    SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id % 5 = 0 THEN 'faq' WHEN doc_id % 4 = 2 THEN 'troubleshooting' WHEN doc_id % 4 = 1 THEN 'getting_started' ELSE 'developer_guide' END
        WHEN regexp_matches(lower(t), 'getting started|quickstart|quick start|installation|install |prerequisites') THEN 'getting_started'
        WHEN regexp_matches(lower(t), 'troubleshoot|known issue|common error|debugging') THEN 'troubleshooting'
        WHEN regexp_matches(lower(t), 'faq|frequently asked') THEN 'faq' ELSE 'developer_guide' END AS category FROM c
""")
def classify_category(spark, d):
    kind = F.col("doc_id") % 4
    title = F.when(kind == 1, " Environment setup").when(kind == 2, " Unsupported input").otherwise(" Page Setup and more")
    text = F.coalesce("text", F.lit(""))
    titled = F.concat(F.lit("FQN: Doc: "), F.coalesce("lang", F.lit("")), title, F.lit("\n"), F.when(F.col("doc_id") % 5 == 0, "FAQ: ").otherwise(""), text)
    return read(spark, d, "documents").select("doc_id", predicates.category(F.when(kind == 0, text).otherwise(titled)).alias("category"))


@query("""
    WITH q AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS ws FROM conversations)
    SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN t LIKE '% %' THEN 'phrase' WHEN t LIKE '%.%' OR regexp_matches(t, '^\\p{Lu}') THEN 'exact_fqn' ELSE 'keyword' END AS shape,
      len(ws) >= 3 OR coalesce(lower(regexp_replace(ws[1], '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) IN ('how', 'what', 'why', 'can', 'could', 'does', 'do', 'did', 'is', 'are', 'was', 'were',
        'should', 'would', 'will', 'where', 'when', 'who', 'which', 'shall'), false) AS task FROM q
""")
def query_shape(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.query_shape("text").alias("shape"), predicates.task_question(F.coalesce("text", F.lit(""))).alias("task"))


@query(r"SELECT role, regexp_matches(text, '(?i)[a-z0-9]{2}|\bc(?:\+\+|#)') AS enough, count(*) AS n FROM conversations GROUP BY ALL")
def minimum_evidence(spark, d):
    return read(spark, d, "conversations").groupBy("role", T.has_minimum_evidence("text").alias("enough")).agg(F.count("*").alias("n"))


@query(f"""
    WITH t AS (SELECT item_id, unnest({O.plain_tokens('text')}) AS token FROM benchmark), b AS (SELECT item_id, (('0x' || left(sha256(token), 16))::UBIGINT % 64)::INT AS bucket FROM t),
    c AS (SELECT item_id, bucket, count(*) AS n FROM b GROUP BY ALL), l AS (SELECT item_id, sqrt(sum(n * n)) AS length FROM c GROUP BY item_id)
    SELECT item_id, bucket, round(n / length, 6) AS value FROM c JOIN l USING (item_id)
""")
def hash_embedding(spark, d):
    v = read(spark, d, "benchmark").select("item_id", F.posexplode(vectors.hash_embedding(T.plain_tokens("text"))).alias("bucket", "value"))
    return v.where("value > 0").select("item_id", "bucket", F.round("value", 6).alias("value"))


@query("SELECT vec_id, list_sum(list_transform(embedding, lambda x: round_even(x::DOUBLE * 1024, 0)::BIGINT))::BIGINT AS total FROM embeddings")
def quantize_vector(spark, d):
    v = vectors.quantised(F.transform(vectors.doubles("embedding"), lambda x: x * 1024), 0)
    return read(spark, d, "embeddings").select("vec_id", F.aggregate(v, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint")).alias("total"))


COSINE = "list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * (SELECT list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


def _first_vector(spark, d) -> list[float]:
    return read(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]


@query(f"SELECT vec_id, round({COSINE}, 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 10")
def cosine_topk(spark, d):
    return vectors.cosine_top_k(read(spark, d, "embeddings"), _first_vector(spark, d), 10).select("vec_id", F.round("score", 6).alias("score"))


@query(f"""
    SELECT vec_id, CASE WHEN s >= 0.3 THEN 'confident' ELSE 'weak' END AS label FROM (SELECT vec_id, round({COSINE}, 6) AS s
    FROM embeddings) WHERE s >= 0.2
""")
def cosine_floor(spark, d):
    q = F.lit([float(x) for x in _first_vector(spark, d)])
    s = vectors.indexed(read(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id", F.round(vectors.cosine(F.col("v"), q, F.col("norm")), 6).alias("s"))
    return s.where("s >= 0.2").select("vec_id", predicates.cosine_label("s", 0.2, 0.3).alias("label"))


@query("""
    SELECT label, count(*) AS n, round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS mean_norm
    FROM embeddings GROUP BY label
""")
def vector_norms(spark, d):
    return vectors.indexed(read(spark, d, "embeddings").withColumn("key", F.struct("vec_id", "label")), "key", "embedding").groupBy(F.col("key.label").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("norm"), 6).alias("mean_norm"))


@query("SELECT sha256(coalesce(text, '')) AS text_sha, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def embedding_cache_last_wins(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("file_ord"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha"), F.array(F.lit(1.0)).alias("vector"))
    return vectors.merged_cache(docs).select("text_sha", F.col("file_ord").alias("doc_id"))


@query("""
    SELECT (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0 AND sha256(coalesce(text, '')) IN (SELECT sha256(coalesce(text, ''))
    FROM documents WHERE doc_id % 3 = 0)) AS hits, (SELECT count(*) FROM documents WHERE doc_id % 3 <> 0
    AND sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 3 = 0)) AS misses
""")
def embedding_cache_lookup(spark, d):
    docs = read(spark, d, "documents")
    cache = docs.where("doc_id % 3 = 0").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha"), F.array(F.lit(1.0)).alias("vector")).distinct()
    hit, miss = vectors.cached(docs.where("doc_id % 3 <> 0"), cache)
    return hit.agg(F.count("*").alias("hits")).crossJoin(miss.agg(F.count("*").alias("misses")))


@query(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark, d):
    return read(spark, d, "pages").select("page_id", chunking.html_title("html").alias("title"))


@query(r"""
    SELECT page_id, len(regexp_extract_all(html, '(?is)<p\b[^>]*>')) AS n_paragraphs, len(regexp_extract_all(html, '(?is)<a\b[^>]*href=')) AS n_links, regexp_matches(html, '(?is)<!--.*?-->') AS has_comment
    FROM pages
""")
def html_paragraphs(spark, d):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0)))
    return read(spark, d, "pages").select("page_id", n(r"(?is)<p\b[^>]*>").alias("n_paragraphs"), n(r"(?is)<a\b[^>]*href=").alias("n_links"), F.regexp_like("html", F.lit("(?is)<!--.*?-->")).alias("has_comment"))


@query()
def html_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(chunking.html_text("html")).alias("text_md5"), F.length(chunking.html_text("html")).alias("n_chars"))


@query(r"""
    SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1),
    '') AS page FROM pages
""")
def url_parts(spark, d):
    return read(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"), F.parse_url("url", F.lit("QUERY"), F.lit("page")).alias("page"))


@query("""
    SELECT source, text, doc_id FROM (SELECT source, text, doc_id, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS r
    FROM documents) WHERE r = 1
""")
def dedupe_first(spark, d):
    return budget.first_of_each(read(spark, d, "documents").select("source", "text", "doc_id"), ["source", "text"], ["doc_id"])


@query("""
    SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(strlen(text)) OVER (PARTITION BY source
    ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents WHERE text IS NOT NULL) WHERE used <= 24576
""")
def byte_budget_prefix(spark, d):
    docs = read(spark, d, "documents").where("text is not null")
    return budget.byte_prefix(docs.withColumn("size", F.octet_length("text")), ["source"], "doc_id", F.col("size"), 24_576).select("source", "doc_id", "used")


@query("""
    SELECT doc_id, md5(CASE WHEN length(text) <= 1500 THEN text WHEN strpos(left(text, 1500),
    chr(10)) > 0 THEN regexp_replace(left(text, 1500), '(?s)\\n[^\\n]*$', '') ELSE left(text, 1500) END) AS cut_md5 FROM documents
    WHERE text IS NOT NULL
""")
def cut_at_line(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.md5(budget.cut_at_line("text", 1500)).alias("cut_md5"))


@query(r"""
    SELECT doc_id, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', E'\\1\x01', 'g'), E'\x01'),
    lambda s: trim(s) <> '')) AS n_sentences FROM documents WHERE text IS NOT NULL
""")
def sentence_split(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.size(chunking.sentences("text")).alias("n_sentences"))


LICENCE_PARTS = (
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "Apache License\n  Version 2.0, January 2004",
    "redistribution and use in source and binary forms, with or without  modification, are permitted",
    "Neither the name of",
)


@query("""
    WITH t AS (SELECT doc_id, list_filter(range(5), lambda i: (doc_id >> i) % 2 = 1) AS p FROM documents)
    SELECT doc_id, CASE WHEN m + a + b = 1 THEN CASE WHEN m = 1 THEN 'MIT' WHEN a = 1 THEN 'Apache-2.0' WHEN list_contains(p, 4) THEN 'BSD-3-Clause' ELSE 'BSD-2-Clause' END END AS license
    FROM (SELECT doc_id, p, (list_contains(p, 0) AND list_contains(p, 1))::INT AS m, list_contains(p, 2)::INT AS a, list_contains(p, 3)::INT AS b FROM t)
""")
def licence_fingerprint(spark, d):
    """Every document with the phrases behind it that its number's bits name."""
    parts = F.concat(*[F.when(F.shiftright("doc_id", i) % 2 == 1, F.lit(f"\n{part}")).otherwise("") for i, part in enumerate(LICENCE_PARTS)])
    return read(spark, d, "documents").select("doc_id", predicates.licence(F.concat(F.coalesce("text", F.lit("")), parts)).alias("license"))


@query()
def nfkc_fold(spark, d):
    @F.pandas_udf("string")
    def nfkc(x: pd.Series) -> pd.Series:
        return x.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return read(spark, d, "documents").select("doc_id", F.md5(T.strip_zero_width(nfkc("text"))).alias("text_md5"))


@query("""
    SELECT doc_id, kind, name, n_methods, commit FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'symbol' WHEN 1 THEN 'example'
    ELSE 'documentation' END AS kind, (CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Example: '
    ELSE 'Doc: ' END) || source || '.T' || doc_id AS name, 2 AS n_methods, lang AS commit FROM documents)
""")
def chunk_grammar(spark, d):
    kind = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "Example: ").otherwise("Doc: ")
    chunk = F.concat(F.lit("FQN: "), kind, F.col("source"), F.lit(".T"), F.col("doc_id").cast("string"), F.lit("\nKind: class\nMethods:\n  - open(path: str)\n  - close() [inherited from Base]\nSource-Commit: "), F.col("lang"))
    c = read(spark, d, "documents").select("doc_id", chunk.alias("text"))
    return c.select("doc_id", predicates.chunk_kind("text").alias("kind"), grammar.fqn("text").alias("name"), F.size(grammar.signature("text")["methods"]).alias("n_methods"), grammar.header("text", "Source-Commit").alias("commit"))
