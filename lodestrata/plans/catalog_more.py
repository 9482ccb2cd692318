"""Queries of the nine tools, and of extraction, releases and sidecars."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import grammar, predicates
from lodestrata.functions import text as T
from lodestrata.operators import extract, lexical, releases, symbols, vectors
from lodestrata.sources import sidecars

from . import oracle as O
from .catalog_text import parts, read
from .tools import Engine

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def engine(spark, d) -> Engine:
    """Documents are documentation, parts are symbols, benchmark passages are examples of one scope."""
    docs = read(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    symbol = F.concat(F.lit("FQN: "), "name", F.lit(".P"), F.col("p_partkey").cast("string"), F.lit("\nKind: class\nMethods:\n  - open_"), F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("(path: str)\n  - size() [inherited from Base]\nSource-Commit: "), F.lower(F.md5("p_brand")))
    parts_ = parts(spark, d).select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("chunk_id"), (F.col("p_partkey") + 1_000_000).alias("ord"), symbol.alias("text"))
    examples = read(spark, d, "benchmark").select(F.concat(F.lit("e"), F.col("item_id").cast("string")).alias("chunk_id"), (F.col("item_id") + 2_000_000).alias("ord"), F.concat(F.lit("FQN: Example: "), F.substring_index("text", " ", 4), F.lit("\nKind: verified_example\nRuntime-Status: ran\n"), "text", F.lit("\nExample:\nrun("), F.col("item_id").cast("string"), F.lit(")\n")).alias("text"))
    return Engine(spark, "goods", "python", docs.unionByName(parts_).unionByName(examples))


@query(f"SELECT true AS found, {O.PART_NAME} || '.P7' AS fqn, 2 AS n_methods FROM part WHERE p_partkey = 7")
def tool_get_symbol(spark, d):
    return engine(spark, d).get_symbol("P7").select("found", "fqn", F.size("signature.methods").alias("n_methods"))


@query("""
    SELECT true AS found, 0 AS place, 'methods' AS header, 'open_' || replace(p_name, ' ', '_') AS name FROM part WHERE p_partkey = 7
    UNION ALL SELECT true, 1, 'methods', 'size'
""")
def tool_list_members(spark, d):
    return engine(spark, d).list_members("P7").select("found", "place", "header", "name")


@query("""
    SELECT true AS found, md5(p_brand) AS indexed_commit, count(*) AS n_chunks, CAST(NULL AS BOOLEAN) AS fresh, 'unknown' AS basis
    FROM part GROUP BY p_brand ORDER BY count(*) DESC, md5(p_brand) LIMIT 1
""")
def tool_index_freshness(spark, d):
    return engine(spark, d).report_index_freshness().select("found", "indexed_commit", "n_chunks", "fresh", "basis")


@query("""
    WITH e AS (SELECT item_id, array_to_string(list_slice(string_split(text, ' '), 1, 4), ' ') AS title FROM benchmark),
    a AS (SELECT title FROM e WHERE item_id = (SELECT min(item_id) FROM e))
    SELECT true AS found, 'title' AS basis, 'confident' AS confidence, 'e' || item_id AS chunk_id, 'run(' || item_id || ')' AS code FROM e
    WHERE lower(trim(title)) = (SELECT lower(trim(title)) FROM a) ORDER BY 4 LIMIT 5
""")
def tool_find_examples(spark, d):
    """Examples by the title of the first one."""
    first = read(spark, d, "benchmark").orderBy("item_id").first()["text"]
    return engine(spark, d).find_examples(" ".join(first.split(" ")[:4])).select("found", "basis", "confidence", "chunk_id", "code")


@query(f"""
    SELECT true AS found, {O.PART_NAME} || '.P' || p_partkey AS fqn, 1 AS tier FROM part WHERE p_partkey = 7
""")
def tool_lookup(spark, d):
    """A bare name: its symbol first."""
    return engine(spark, d).lookup("P7", top_k=1).select("found", F.col("name").alias("fqn"), F.lit(1).alias("tier"))


@query("""
    SELECT true AS found, 'v1.' || p_partkey AS tag_name, CASE WHEN p_size % 2 = 0 THEN 'detailed' ELSE 'templated' END AS richness, p_partkey <= 150 AS in_index
    FROM part ORDER BY p_partkey DESC LIMIT 10
""")
def tool_recent_changes(spark, d):
    body = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Fixed `"), "p_name", F.lit("`."))).otherwise("A new release.")
    r = read(spark, d, "part").select(F.concat(F.lit("v1."), F.col("p_partkey").cast("string")).alias("tag_name"), body.alias("body"), F.lit(None).cast("string").alias("target_commitish"), F.col("p_partkey").alias("ord"))
    return engine(spark, d).list_recent_changes(r, "abc1234", "1.150").select("found", "tag_name", "richness", "in_index")


@query("""
    SELECT true AS found, 'license' AS section, 'MIT' AS text
    UNION ALL SELECT true, 'support', text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)
    UNION ALL SELECT false, NULL, NULL
""")
def tool_product_reference(spark, d):
    """A licence by its text, a section as it is staged, and one that is not there."""
    first = read(spark, d, "benchmark").orderBy("item_id").first()["text"]
    inputs = {"license_text": "MIT License\n\n" + "\n\n".join(predicates.MIT), "support": first}
    e = engine(spark, d)
    answers = [e.get_product_reference(section, inputs).select("found", "section", "text") for section in ("license", "support", "formats")]
    return answers[0].unionByName(answers[1]).unionByName(answers[2])


@query("""
    SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'not_compiled' WHEN p_size % 3 = 0 THEN 'not_run'
    WHEN p_partkey % 4 = 0 THEN 'failed' WHEN p_partkey % 7 = 0 THEN 'no_output' ELSE 'ran' END AS verdict FROM part
""")
def run_verdict(spark, d):
    v = extract.run_verdict(F.col("p_size") % 5 != 0, F.col("p_size") % 3 != 0, (F.col("p_partkey") % 4 == 0).cast("int"), F.col("p_partkey") % 7)
    return read(spark, d, "part").select("p_partkey", v.alias("verdict"))


@query("""
    WITH w AS (SELECT unnest(regexp_extract_all(text, '[a-zA-Z0-9_]+')) AS name FROM documents) SELECT name, count(*) AS n FROM w
    WHERE name IN (SELECT unnest(regexp_extract_all(text, '[a-zA-Z0-9_]+')) FROM benchmark) GROUP BY name
""")
def mention_counts(spark, d):
    names = read(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\w+"), F.lit(0))).alias("name"))
    return extract.mentions(read(spark, d, "documents"), names)


@query("""
    SELECT c_mktsegment AS section, coalesce(min(c_name) FILTER (WHERE c_custkey % 5 = 0 AND c_mktsegment <> 'MACHINERY'),
    max(c_name)) AS text FROM customer GROUP BY 1
""")
def merged_sections(spark, d):
    c = read(spark, d, "customer")
    p = c.where("c_custkey % 5 = 0 and c_mktsegment <> 'MACHINERY'").groupBy(F.col("c_mktsegment").alias("section")).agg(F.min("c_name").alias("text")).withColumn("faq_only", F.lit(False))
    return releases.merged_sections(p, c.groupBy(F.col("c_mktsegment").alias("section")).agg(F.max("c_name").alias("text"))).select("section", "text")


def _tags(spark, d, every: int, prefix: str):
    """Every so many parts are a release or a tag, with its number."""
    p = read(spark, d, "part").where(F.pmod("p_partkey", F.lit(every)) == 0)
    return p.select(F.concat(F.lit(prefix), F.col("p_partkey").cast("string")).alias("tag_name"), F.col("p_partkey").alias("ord"))


@query("""
    WITH r AS (SELECT p_partkey AS minor FROM part WHERE p_partkey % 10 = 0), t AS (SELECT p_partkey AS minor FROM part WHERE p_partkey % 7 = 0)
    SELECT 'v3.' || minor AS tag_name, 'release' AS source FROM r UNION ALL SELECT '3.' || minor, 'tag' FROM t WHERE minor > (SELECT max(minor) FROM r)
""")
def newer_tags(spark, d):
    return releases.merge_newer_tags(_tags(spark, d, 10, "v3."), _tags(spark, d, 7, "3.")).select("tag_name", "source")


@query("""
    WITH r AS (SELECT p_partkey AS minor FROM part WHERE p_partkey % 10 = 0), t AS (SELECT p_partkey AS minor FROM part WHERE p_partkey % 7 = 0)
    SELECT 'v3.' || minor AS tag_name, 'release' AS source FROM r
    UNION ALL (SELECT '3.' || minor, 'tag' FROM t WHERE minor NOT IN (SELECT minor FROM r) ORDER BY minor DESC LIMIT greatest(0, 1000 - (SELECT count(*) FROM r)))
""")
def older_tags(spark, d):
    return releases.pad_with_older_tags(_tags(spark, d, 10, "v3."), _tags(spark, d, 7, "3."), 1000)


@query("SELECT doc_id, 'the digest is not the code''s' AS problem FROM documents WHERE doc_id % 2 = 1 AND trim(coalesce(text, '')) <> ''")
def sidecar_problems(spark, d):
    e = read(spark, d, "documents").where("trim(coalesce(text, '')) <> ''").select(F.col("doc_id").cast("string").alias("pilot"), F.lit("t").alias("title"), F.lit("").alias("description"), F.lit("x = 1").alias("code"), F.when(F.col("doc_id") % 2 == 1, "0").otherwise(T.code_hash(F.lit("x = 1"))).alias("code_sha256"))
    return sidecars.example_problems(e).select(F.col("pilot").cast("long").alias("doc_id"), "problem")


@query("SELECT p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN 'readme' ELSE 'authored' END AS origin, p_partkey FROM part p WHERE p_partkey % 2 = 0 OR NOT EXISTS (SELECT 1 FROM part q WHERE q.p_partkey % 2 = 0 AND q.p_size < 10 AND q.p_name = p.p_name) AND p_partkey % 2 = 1".replace("WHERE p_partkey % 2 = 0 OR", "WHERE (p_partkey % 2 = 0 AND p_size < 10) OR"))
def merged_candidates(spark, d):
    p = read(spark, d, "part").select(F.col("p_name").alias("title"), F.col("p_partkey").alias("code"), "p_size")
    return sidecars.merged_candidates(p.where("code % 2 = 0 and p_size < 10"), p.where("code % 2 = 1")).withColumnRenamed("code", "p_partkey")


@query("""
    SELECT e.item_id AS example_id, m.w AS member, m.p_brand AS owner
    FROM (SELECT item_id, unnest(list_distinct(regexp_extract_all('x.ring() y.' || CASE WHEN item_id % 2 = 0 THEN 'widget'
    ELSE 'red' END || ' z::small', '(?:\\.|->|::)\\s*([A-Za-z_]\\w*)', 1))) AS c FROM benchmark) e
    JOIN (SELECT DISTINCT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) m ON m.w = e.c
""")
def called_members(spark, d):
    m = read(spark, d, "part").select(F.col("p_brand").alias("owner"), F.explode(F.split("p_name", " ")).alias("member"))
    code = F.concat(F.lit("x.ring() y."), F.when(F.col("item_id") % 2 == 0, "widget").otherwise("red"), F.lit(" z::small"))
    return symbols.called_members(read(spark, d, "benchmark").select(F.col("item_id").alias("example_id"), code.alias("code")), m)


@query("""
    WITH w AS (SELECT item_id, string_split(regexp_replace(text, '[`\\n]', ' ', 'g'), ' ') AS ws FROM benchmark)
    SELECT item_id, md5(array_to_string(list_transform(ws, lambda w: CASE WHEN w IN ('hand', 'of', 'the') THEN '`' || w || '`' ELSE w END), ' ')) AS text_md5 FROM w
""")
def neutralised_anchors(spark, d):
    """Every word as an anchor; those that are not known lose their marks."""
    words = F.split(F.regexp_replace("text", "[`\\n]", " "), " ")
    said = F.array_join(F.transform(words, lambda w: F.concat(F.lit("`"), w, F.lit("`"))), " ")
    return read(spark, d, "benchmark").select("item_id", F.md5(T.neutralised(said, F.array(*map(F.lit, ("hand", "of", "the"))))).alias("text_md5"))


@query("SELECT vec_id FROM embeddings WHERE label = 1")
def vector_scope(spark, d):
    """Only rows in scope reach the scoring."""
    return vectors.indexed(read(spark, d, "embeddings").where("label = 1"), "vec_id", "embedding").select("vec_id")


@query("SELECT p_partkey, 3 AS kept_types, 4 AS types, 'This index holds 3 of 4 types.' AS note FROM part WHERE p_size = 1")
def coverage_note(spark, d):
    t = F.lit("FQN: x\nAPI-Coverage: 3 of 4 types; 2 of 2 functions")
    c = grammar.coverage(t)
    return read(spark, d, "part").where("p_size = 1").select("p_partkey", c["kept_types"].cast("int").alias("kept_types"), c["types"].cast("int").alias("types"), grammar.coverage_note(t).alias("note"))


@query(f"""
    SELECT word, len(forms) AS n_forms FROM (SELECT DISTINCT token AS word, list_distinct(list_concat([token, token || 's'], CASE
    WHEN token LIKE '%ies' AND length(token) > 3 THEN [left(token, -3) || 'y'] ELSE [] END, CASE WHEN token LIKE '%es'
    AND length(token) > 3 THEN [left(token, -2), left(token, -1)] WHEN token LIKE '%s' AND length(token) > 2 THEN [left(token, -1)]
    ELSE [] END, CASE WHEN token LIKE '%ing' AND length(token) > 5 THEN [left(token, -3), left(token, -3) || 'e'] ELSE [] END, CASE
    WHEN token LIKE '%ed' AND length(token) > 4 THEN [left(token, -2), left(token, -1)] ELSE [] END)) AS forms
    FROM (SELECT unnest({O.plain_tokens('text')}) AS token FROM benchmark))
""")
def inflected_forms(spark, d):
    words = read(spark, d, "benchmark").select(F.explode(T.plain_tokens("text")).alias("word")).distinct()
    return words.select("word", F.size(T.inflections("word")).cast("long").alias("n_forms"))


@query(f"""
    SELECT query_id, count(*) AS n FROM (SELECT item_id AS query_id, unnest({O.stemmed_terms('text')}) AS term FROM benchmark)
    WHERE term NOT IN (SELECT unnest(['library', 'api', 'example', 'sample', 'use', 'how', 'of', 'hand'])) GROUP BY 1
""")
def distinctive_terms(spark, d):
    terms = T.distinctive_terms("text", T.excluded_terms("of", "hand"))
    return read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.size(terms).cast("long").alias("n")).where("n > 0")


@query(f"""
    WITH t AS (SELECT item_id AS query_id, unnest({O.stemmed_terms('text')}) AS term FROM benchmark), e AS (SELECT * FROM documents WHERE lang = 'en'),
    f AS (SELECT {O.stem('token')} AS term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({O.tokens("coalesce(text, '')")}) AS token FROM e) GROUP BY 1)
    SELECT query_id, term, round(CASE WHEN f.df IS NULL THEN 2.0 ELSE greatest(0.5, least(1.0, ln(1 + (SELECT count(*) FROM e) / (1 + f.df)))) END, 6) AS weight FROM t LEFT JOIN f USING (term)
""")
def scoped_weights(spark, d):
    """Weights over the documents of one kind only."""
    terms = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(T.stemmed_terms("text")).alias("term"))
    return lexical.weighted_terms(read(spark, d, "documents").where("lang = 'en'"), terms).select("query_id", "term", F.round("weight", 6).alias("weight"))
