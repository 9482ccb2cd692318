"""Queries of what links one entry to another: exports of modules, re-exported shells, terms with synonyms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata.functions import relevance
from lodestrata.functions.providers import Hashing
from lodestrata.operators import exports, graph, symbols
from lodestrata.operators.staging import cut, shared_folder
from lodestrata.sources.embedding_cache import EmbeddingCache

from . import oracle as O
from .catalog_text import parts, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Parts as a tree of modules: each holds an item named by its size, is a child of a third of its number, takes all of the
#: next one, renames an item of its first child, takes all of its first child, or of its parent's next one.
MODULES = """
    WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size AS s FROM part),
    base AS (SELECT k // 3 AS module, 'm' || k AS name, 'module' AS kind, k AS target, NULL::VARCHAR AS item, k % 5 <> 0 AS public FROM p
             UNION SELECT k, 'T' || s, 'item', k, 'T' || s, s % 4 <> 0 FROM p),
    e AS (SELECT p.k AS owner, p.k + 1 AS source, NULL::VARCHAR AS name, NULL::VARCHAR AS bound, true AS public FROM p WHERE k % 3 = 0
          UNION SELECT p.k, c.k, 'T' || c.s, 'R' || p.k, true FROM p JOIN p c ON c.k = 3 * p.k + 1 WHERE p.k % 3 = 1
          UNION SELECT p.k, 3 * p.k, NULL, NULL, p.k % 8 = 1 FROM p WHERE k % 4 = 1
          UNION SELECT p.k, p.k // 3 + 1, NULL, NULL, true FROM p WHERE k % 3 = 2 AND (k // 3) % 3 <> 2 AND k > 3),
    n AS (SELECT * FROM base UNION SELECT e.owner, coalesce(e.bound, n.name), n.kind, n.target, n.item, e.public
          FROM n JOIN e ON e.source = n.module AND ((e.name IS NULL AND n.public) OR e.name = n.name))
"""


def modules(spark, d):
    part = read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").alias("s"))
    s = lambda x: x.cast("string")
    k, name = F.col("k"), lambda x: F.concat(F.lit("m"), s(x))
    scope = F.lit("parts").alias("scope")
    root = spark.range(1).select(scope, F.lit("0").alias("module"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("name"), F.lit(True).alias("public"))
    tree = root.unionByName(part.select(scope, s(k).alias("module"), s(F.floor(k / 3)).alias("parent"), name(k).alias("name"), (k % 5 != 0).alias("public")))
    items = part.select(scope, s(k).alias("module"), F.concat(F.lit("T"), s(F.col("s"))).alias("name"), (F.col("s") % 4 != 0).alias("public"))
    use = lambda rows, path, bound, public: rows.select(scope, s(k).alias("module"), path.alias("path"), bound.cast("string").alias("bound"), public.alias("public"))
    child = part.join(part.select(((k - 1) / 3).cast("long").alias("k"), k.alias("c"), F.col("s").alias("cs")).where("c % 3 = 1"), "k").where("k % 3 = 1")
    uses = use(part.where("k % 3 = 0"), F.array(F.lit("super"), name(k + 1)), F.lit(None), F.lit(True))
    uses = uses.unionByName(use(child, F.array(F.lit("self"), name(F.col("c")), F.concat(F.lit("T"), s(F.col("cs")))), F.concat(F.lit("R"), s(k)), F.lit(True)))
    uses = uses.unionByName(use(part.where("k % 4 = 1"), F.array(name(k * 3)), F.lit(None), k % 8 == 1))
    up = part.where("k % 3 = 2 AND floor(k / 3) % 3 <> 2 AND k > 3")
    uses = uses.unionByName(use(up, F.array(F.lit("super"), F.lit("super"), name(F.floor(k / 3) + 1)), F.lit(None), F.lit(True)))
    return tree, items, uses


@query(MODULES + "SELECT module::VARCHAR AS module, name, kind, target::VARCHAR AS target, item FROM n WHERE public")
def module_exports(spark, d):
    return exports.resolved_names(*modules(spark, d)).where("public").select("module", "name", "kind", "target", "item")


#: Parts as entries of a library: half of those of a brand's first file are stubs without members.
ENTRIES = """
    WITH e AS (SELECT p_partkey AS id, 'N' || (p_partkey // 3) AS name, CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'enum' END AS kind,
        'pkg.' || lower(split_part(p_type, ' ', 1)) || CASE WHEN p_size % 4 = 0 THEN '' ELSE '.' || lower(split_part(p_type, ' ', 2)) END || '.N' || (p_partkey // 3) AS path,
        CASE WHEN p_size % 4 = 0 THEN 'pkg/__init__.py' WHEN p_size % 11 = 0 THEN 'lib.cpp' ELSE 'pkg/part.py' END AS file,
        CASE WHEN p_size % 4 = 0 OR p_size % 7 = 0 THEN 0 ELSE 2 END AS members, p_size % 13 = 0 AS is_test FROM part),
    u AS (SELECT s.id AS shell, d.id AS definition, count(*) OVER (PARTITION BY s.id) AS n
          FROM (SELECT * FROM e WHERE members = 0 AND file LIKE '%\\_\\_init\\_\\_.py' ESCAPE '\\') s
          JOIN e d ON d.name = s.name AND d.id <> s.id AND d.members > 0 AND NOT d.is_test AND starts_with(d.path, regexp_replace(s.path, '[^.]*$', ''))),
    a AS (SELECT shell, definition FROM u WHERE n = 1),
    f AS (SELECT name, kind, count(*) AS n, min(id) AS definition FROM e WHERE members > 0 AND file LIKE '%.py' AND NOT is_test GROUP BY ALL HAVING count(*) = 1),
    b AS (SELECT e.id AS shell, f.definition FROM e JOIN f USING (name, kind) WHERE e.members = 0 AND e.file LIKE '%.py' AND e.id NOT IN (SELECT shell FROM a))
    SELECT shell, definition, 'package' AS basis FROM a UNION ALL SELECT shell, definition, 'name' FROM b
"""


@query(ENTRIES)
def stub_pairs(spark, d):
    part = read(spark, d, "part")
    name = F.concat(F.lit("N"), F.floor(F.col("p_partkey") / 3).cast("string"))
    word = lambda c, n: F.split_part(F.col(c), F.lit(" "), F.lit(n))
    inner = F.when(F.col("p_size") % 4 == 0, "").otherwise(F.concat(F.lit("."), F.lower(word("p_type", 2))))
    entries = part.select(
        F.col("p_partkey").alias("id"),
        name.alias("name"),
        F.when(F.col("p_size") % 2 == 0, "class").otherwise("enum").alias("kind"),
        F.concat(F.lit("pkg."), F.lower(word("p_type", 1)), inner, F.lit("."), name).alias("import_path"),
        F.when(F.col("p_size") % 4 == 0, "pkg/__init__.py").when(F.col("p_size") % 11 == 0, "lib.cpp").otherwise("pkg/part.py").alias("file"),
        F.when((F.col("p_size") % 4 == 0) | (F.col("p_size") % 7 == 0), 0).otherwise(2).alias("members"),
        (F.col("p_size") % 13 == 0).alias("is_test"),
    )
    return graph.stub_pairs(entries)


FAMILY = "hands"
VERBS = O.strings(sorted({symbols._canonical(w) for w in (*relevance.ACTIONS, *relevance.WEAK)}))
GROUPS = "CASE concept " + " ".join(f"WHEN '{symbols._canonical(w)}' THEN [{O.strings(symbols._canonical(x) for x in g if x != w)}]" for g in relevance.SYNONYMS for w in g) + " ELSE [] END"


@query(f"""
    WITH a AS (SELECT item_id AS q, 'convert ' || text || ' hands hand save' AS text FROM benchmark),
    c AS (SELECT q, flatten(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda r: CASE WHEN len({O.case_parts('r')}) > 1 THEN list_concat([r], {O.case_parts('r')}) ELSE [r] END)) AS ws FROM a),
    w AS (SELECT q, lower(unnest(ws)) AS word, generate_subscripts(ws, 1) - 1 AS place FROM c),
    p AS (SELECT DISTINCT lower(x[1]) AS one, lower(x[2]) AS two FROM (SELECT regexp_extract_all(text, '[A-Za-z0-9]+') AS x FROM benchmark) WHERE len(x) > 1),
    u AS (SELECT word, {O.stem('word')} AS s FROM (SELECT word FROM w UNION SELECT one FROM p UNION SELECT two FROM p)),
    l AS (SELECT word, s, CASE WHEN length(s) > 5 AND s LIKE '%ly' THEN left(s, -2) ELSE s END AS t FROM u),
    k AS (SELECT word, s, CASE WHEN length(t) > 3 AND t LIKE '%e' THEN left(t, -1) ELSE t END AS concept FROM l),
    f AS (SELECT q, concept, min({{'place': place, 'word': w.word}}) AS x FROM w JOIN k USING (word) WHERE NOT regexp_matches(w.word, '^[a-z]$') AND w.word NOT IN ({O.STOP}, 'disk', 'scratch') GROUP BY q, concept),
    v AS (SELECT p.one, i.concept AS same, j.concept AS value FROM p JOIN k i ON i.word = p.one JOIN k j ON j.word = p.two),
    m AS (SELECT same, list(DISTINCT value) AS vs FROM v GROUP BY same), o AS (SELECT one, list(DISTINCT value) AS vs FROM v GROUP BY one),
    g AS (SELECT q, f.concept, x.place, x.word, k.s, list_sort(list_distinct(list_concat([f.concept], {GROUPS.replace('concept', 'f.concept')}, coalesce(m.vs, []), coalesce(o.vs, [])))) AS forms
          FROM f JOIN k ON k.word = f.x.word LEFT JOIN m ON m.same = f.concept LEFT JOIN o ON o.one = f.x.word),
    h AS (SELECT *, word = '{FAMILY}' OR s IN ('library', 'api', 'example', 'sample', 'use', 'how') AS common, s = 'hand' AND word <> '{FAMILY}' AS family_stem FROM g),
    z AS (SELECT *, concept IN ({VERBS}) OR family_stem AS light, sum((NOT common)::INT) OVER (PARTITION BY q) AS kept FROM h),
    y AS (SELECT *, max((NOT light)::INT) OVER (PARTITION BY q) AS strong FROM z WHERE NOT common OR kept = 0)
    SELECT q AS query_id, place, concept, word, array_to_string(forms, ' ') AS forms, light AND (strong = 1 OR kept = 0 OR NOT family_stem) AS light, family_stem FROM y
""")
def evidence_terms(spark, d):
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("convert "), "text", F.lit(" hands hand save")).alias("query"))
    runs = F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))
    pairs = read(spark, d, "benchmark").select(F.get(runs, 0).alias("word"), F.get(runs, 1).alias("value")).where("value IS NOT NULL").distinct()
    return symbols.evidence_terms(asked, FAMILY, pairs).withColumn("forms", F.array_join("forms", " "))


#: Each part's name against a task that holds a term and the synonyms of what the name says.
ANCHORED = ("color", "worksheet", "export", "conversion", "large")


@query(f"""
    WITH p AS (SELECT p_partkey, {O.PART_NAME} || CASE p_size % 6 WHEN 0 THEN ' Colour' WHEN 1 THEN ' Save' WHEN 2 THEN ' Sheets' WHEN 3 THEN ' Convert Tab' ELSE '' END AS name FROM part),
    t AS (SELECT p_partkey, list_slice({list(ANCHORED)}, p_partkey % 3 + 1, p_partkey % 3 + 1 + p_partkey % 2) AS terms, list_transform({O.tokens('name')}, lambda x: {O.stem('x')}) AS ws FROM p),
    s AS (SELECT * FROM (VALUES ('color', 'colour'), ('worksheet', 'tab'), ('worksheet', 'sheet'), ('export', 'save'), ('conversion', 'convert')) s(term, other)),
    u AS (SELECT p_partkey, unnest(terms) AS term, len(terms) AS n, ws FROM t)
    SELECT p_partkey, bool_or(list_contains(ws, term) OR EXISTS (SELECT 1 FROM s WHERE s.term = u.term AND list_contains(ws, other) AND (n = 1 OR other <> 'save'))) AS anchored FROM u GROUP BY p_partkey
""")
def synonym_anchors(spark, d):
    named = parts(spark, d).withColumn("name", F.concat("name", F.when(F.col("p_size") % 6 == 0, " Colour").when(F.col("p_size") % 6 == 1, " Save").when(F.col("p_size") % 6 == 2, " Sheets").when(F.col("p_size") % 6 == 3, " Convert Tab").otherwise("")))
    terms = F.slice(F.array(*map(F.lit, ANCHORED)), (F.col("p_partkey") % 3 + 1).cast("int"), (F.col("p_partkey") % 2 + 1).cast("int"))
    return named.select("p_partkey", relevance.title_anchored(terms, "name").alias("anchored"))


@query("""
    WITH e AS (SELECT DISTINCT coalesce(text, '') AS text FROM benchmark WHERE item_id % 2 = 0)
    SELECT item_id, coalesce(text, '') IN (SELECT text FROM e) AS was_there, (SELECT count(*) FROM (SELECT DISTINCT coalesce(text, '') AS text FROM benchmark) t WHERE text NOT IN (SELECT text FROM e)) AS written,
      0::BIGINT AS written_again, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) > 0 AS has_length FROM benchmark
""")
def embedding_write_back(spark, d):
    """Every second text first, then all of them, then all once more."""
    texts = read(spark, d, "benchmark").select("item_id", "text")
    cache = EmbeddingCache(spark, f"{shared_folder(spark)}/embeddings-{uuid.uuid4().hex}")
    cache.fill(texts.where("item_id % 2 = 0"), Hashing())
    there = cut(cache.entries().select("text_sha", F.lit(True).alias("was")))
    written = cache.fill(texts, Hashing())
    again = cache.fill(texts, Hashing())
    known = cache.embedded(texts, Hashing()).withColumn("text_sha", F.sha2(F.coalesce("text", F.lit("")), 256)).join(there, "text_sha", "left")
    return known.select("item_id", F.coalesce("was", F.lit(False)).alias("was_there"), F.lit(written).cast("long").alias("written"), F.lit(again).cast("long").alias("written_again"), F.exists("vector", lambda x: x > 0).alias("has_length"))
