"""Queries over the star tables, used as stand-ins: parts are symbols, orders and lines their references, customers' orders a
publish log, events the telemetry."""

from __future__ import annotations

import functools

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import grammar, predicates, versions
from lodestrata.functions import text as T
from lodestrata.operators import budget, claims, diff, graph, quality, symbols
from lodestrata.streaming import telemetry

from . import oracle as O
from . import publish
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


NAMED = f"p AS (SELECT *, {O.PART_NAME} AS name FROM part)"


@query(f"WITH {NAMED} SELECT name, array_to_string({O.symbol_words('name')}, ' ') AS words FROM p GROUP BY name")
def symbol_words(spark, d):
    return parts(spark, d).select("name").distinct().select("name", F.array_join(T.symbol_words("name"), " ").alias("words"))


TIER = """CASE WHEN lower(q) = lower(name) THEN 0 WHEN lower(q) = lower(regexp_extract(name, '[^.]+$')) THEN 1 WHEN concat(' ', array_to_string({w}, ' '), ' ') LIKE concat('% ', array_to_string({qw}, ' '), ' %') THEN 2 {more} END"""


@query(f"""
    WITH {NAMED} SELECT p_partkey, q AS query, tier
    FROM (SELECT p_partkey, q, {TIER.format(w=O.symbol_words('name'), qw=O.symbol_words('q'), more='')} AS tier
    FROM p, (SELECT unnest(['Economy.SmallRing.B2', 'b17', 'small ring', 'RedWidget']) AS q)) WHERE tier IS NOT NULL
""")
def match_tier(spark, d):
    asked = spark.createDataFrame([(q,) for q in ("Economy.SmallRing.B2", "b17", "small ring", "RedWidget")], "query string")
    named = parts(spark, d).select("p_partkey", "name", T.symbol_words("name").alias("words"))  # each name is cut once
    tiers = named.crossJoin(F.broadcast(asked)).withColumn("tier", symbols.match_tier(F.col("query"), F.col("name"), F.col("words")))
    return tiers.where("tier <= 2").select("p_partkey", "query", "tier")


@query(f"""
    WITH {NAMED}, w AS (SELECT p_partkey, {O.symbol_words('name')} AS ws FROM p) SELECT p_partkey, true AS hit FROM w
    WHERE len(list_filter(range(1, len(ws)), lambda i: ws[i] LIKE 'wid%' AND ws[i + 1] LIKE 'b1%' OR ws[i] LIKE 'wid%'
    AND ws[i + 1] = 'b1')) > 0 OR false
""")
def prefix_tier(spark, d):
    tiers = parts(spark, d).select("p_partkey", symbols.match_tier(F.lit("wid B1x"), F.col("name")).alias("none"), F.exists(F.sequence(F.lit(1), F.size(T.symbol_words("name")) - 1), lambda i: F.startswith(F.get(T.symbol_words("name"), i - 1), F.lit("wid")) & F.startswith(F.get(T.symbol_words("name"), i), F.lit("b1"))).alias("hit"))
    return tiers.where("hit").select("p_partkey", "hit")


@query(f"""
    WITH {NAMED}, n AS (SELECT DISTINCT name FROM p), q AS (SELECT DISTINCT regexp_extract(name, '[^.]+[.][^.]+$') AS query FROM n),
    h AS (SELECT query, name FROM q JOIN n ON lower(name) = lower(query) OR lower(name) LIKE '%.' || lower(query))
    SELECT query, count(*) = 1 AS found, CASE WHEN count(*) = 1 THEN 'suffix' ELSE 'ambiguous' END AS reason, CASE WHEN count(*) = 1 THEN any_value(name) END AS name FROM h GROUP BY query
""")
def suffix_join(spark, d):
    names = parts(spark, d).select("name").distinct()
    asked = names.select(F.regexp_extract("name", r"[^.]+[.][^.]+$", 0).alias("query")).distinct()
    return symbols.resolve(names, asked, "name")


@query("""
    WITH d AS (SELECT p_brand || '.' || replace(p_name, ' ', '_') AS anchor FROM part WHERE p_partkey % 7 = 0), a AS (SELECT DISTINCT p_brand || '.' || replace(p_name, ' ', '_') AS anchor FROM part),
    n AS (SELECT anchor, count(*) AS n FROM d GROUP BY anchor)
    SELECT anchor, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN 'supported' WHEN n > 1 THEN 'partially_supported' ELSE 'unsupported' END AS verdict FROM a LEFT JOIN n USING (anchor)
""")
def exactly_one_anchor(spark, d):
    anchors = read(spark, d, "part").select("p_partkey", F.concat_ws(".", "p_brand", F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))).alias("anchor"))
    return claims.resolved(anchors, anchors.where("p_partkey % 7 = 0").select("anchor"))


@query("""
    WITH v AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 WHEN 'R' THEN 4 END AS sev, l_linenumber, l_shipmode FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem)),
    w AS (SELECT l_orderkey, max(sev) AS sev FROM v GROUP BY l_orderkey)
    SELECT v.l_orderkey, CASE w.sev WHEN 1 THEN 'supported' WHEN 2 THEN 'insufficient_evidence' ELSE 'unsupported' END AS verdict, arg_min(l_linenumber || l_shipmode, l_linenumber * 10 + (l_shipmode = 'O')::INT) AS detail
    FROM v JOIN w ON v.l_orderkey = w.l_orderkey AND v.sev = w.sev GROUP BY v.l_orderkey, w.sev
""")
def worst_verdict(spark, d):
    verdict = F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "N", "insufficient_evidence").when(F.col("l_returnflag") == "R", "unsupported")
    v = read(spark, d, "lineitem").select("l_orderkey", verdict.alias("verdict"), F.concat(F.col("l_linenumber").cast("string"), "l_linestatus").alias("detail"), (F.col("l_linenumber") * 10 + (F.col("l_linestatus") == "O").cast("int")).alias("ord"))
    return claims.worst(v, "l_orderkey")


@query("""
    WITH c AS (SELECT p_partkey, unnest(regexp_extract_all(t, '(\\d[\\d,]*)\\s+(?:rings|widgets)', 1)) AS number, unnest(regexp_extract_all(t, '\\d[\\d,]*\\s+(rings|widgets)', 1)) AS unit FROM (SELECT p_partkey, 'It has ' || p_size || ' rings and 1,0' || (10 + p_size % 10) || ' widgets.' AS t FROM part))
    SELECT p_partkey, replace(number, ',', '')::BIGINT AS number, unit, CASE WHEN unit = 'widgets' THEN CASE WHEN replace(number, ',', '')::BIGINT = 1015 THEN 'supported' ELSE 'unsupported' END ELSE 'insufficient_evidence' END AS verdict FROM c
""")
def numeric_claims(spark, d):
    said = F.concat(F.lit("It has "), F.col("p_size").cast("string"), F.lit(" rings and 1,0"), (F.col("p_size") % 10 + 10).cast("string"), F.lit(" widgets."))
    found = read(spark, d, "part").select("p_partkey", F.explode(claims.numeric_claims(said, ("rings", "widgets"))).alias("c")).select("p_partkey", "c.number", "c.unit")
    return claims.checked_numbers(found, spark.createDataFrame([("widgets", 1015)], "unit string, known long")).select("p_partkey", "number", "unit", "verdict")


@query("""
    WITH c AS (SELECT DISTINCT p_brand AS scope, CASE WHEN p_size % 3 > 0 THEN 'in' || p_size % 3 END AS direction, p_name AS format FROM part WHERE p_partkey % 2 = 0),
    e AS (SELECT DISTINCT p_brand AS scope, 'in' || p_size % 3 AS direction, p_name AS format FROM part WHERE p_partkey % 2 = 1 AND p_brand <> 'Brand#3')
    SELECT scope, direction, format FROM c WHERE scope IN (SELECT scope FROM e) AND NOT EXISTS (SELECT 1 FROM e WHERE e.scope = c.scope AND e.format = c.format AND (c.direction IS NULL OR e.direction = c.direction))
""")
def anti_claims(spark, d):
    part = read(spark, d, "part")
    direction = F.concat(F.lit("in"), (F.col("p_size") % 3).cast("string"))
    c = part.where("p_partkey % 2 = 0").select(F.col("p_brand").alias("scope"), F.when(F.col("p_size") % 3 > 0, direction).alias("direction"), F.col("p_name").alias("format")).distinct()
    e = part.where("p_partkey % 2 = 1 and p_brand <> 'Brand#3'").select(F.col("p_brand").alias("scope"), direction.alias("direction"), F.col("p_name").alias("format")).distinct()
    return claims.unmatched_claims(c, e)


@query("""
    WITH s AS (SELECT p_partkey::VARCHAR AS name, p_brand AS commit, [p_name] AS aliases FROM part), f AS (SELECT DISTINCT p_size AS defect_id, p_name AS ref, CASE WHEN p_size % 2 = 0 THEN p_brand END AS c FROM part WHERE p_partkey % 50 = 0)
    SELECT DISTINCT name, defect_id FROM s JOIN f ON list_contains(list_append(aliases, name), ref) WHERE c IS NULL OR c = commit
""")
def defect_applicability(spark, d):
    part = read(spark, d, "part")
    s = part.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("commit"), F.array("p_name").alias("aliases"))
    f = part.where("p_partkey % 50 = 0").select(F.col("p_size").alias("defect_id"), F.array("p_name").alias("refs"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("indexed_commit"))
    return claims.applicable_defects(s, f)


@query("""
    SELECT p_brand AS scope, p_name AS format, max(CASE WHEN p_size % 5 < 3 THEN p_type END) AS yes, max(CASE WHEN p_size % 5 >= 3 THEN p_type END) AS no FROM part GROUP BY ALL
    HAVING count(CASE WHEN p_size % 5 < 3 THEN 1 END) > 0 AND count(CASE WHEN p_size % 5 >= 3 THEN 1 END) > 0
""")
def format_contradictions(spark, d):
    return claims.format_contradictions(read(spark, d, "part").select(F.col("p_brand").alias("scope"), F.col("p_type").alias("section"), F.col("p_name").alias("format"), (F.col("p_size") % 5 < 3).alias("positive")))


@query("""
    SELECT p_type, p_name, min(CASE WHEN r = 1 THEN p_partkey END) AS p_partkey, list_sort(list(p_partkey) FILTER (WHERE r > 1)) AS aliases
    FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_name ORDER BY CASE WHEN p_size = 50 THEN 0 WHEN p_retailprice > 950 THEN 1 ELSE 2 END, p_partkey) AS r FROM part) GROUP BY ALL
""".replace("list_sort(list(p_partkey) FILTER (WHERE r > 1))", "coalesce(len(list(p_partkey) FILTER (WHERE r > 1)), 0)"))
def alias_collapse(spark, d):
    c = symbols.collapse_aliases(read(spark, d, "part"), ["p_type", "p_name"], F.col("p_size") == 50, F.col("p_retailprice") > 950, "p_partkey", "p_partkey")
    return c.withColumn("aliases", F.size("aliases").cast("long"))


@query("""
    WITH a AS (SELECT p_partkey, p_name, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_brand || '.' || p_name ELSE p_name END AS q FROM part)
    SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY q) > 1 THEN q || '#' || row_number() OVER (PARTITION BY q ORDER BY p_partkey) ELSE q END AS "unique" FROM a
""")
def unique_names(spark, d):
    return symbols.unique_names(read(spark, d, "part"), "p_name", "p_brand", "p_partkey").select("p_partkey", "unique")


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part GROUP BY p_name ORDER BY min(p_partkey), p_name LIMIT 20)")
def slot_cap(spark, d):
    return symbols.slot_cap(read(spark, d, "part"), "p_name", "p_partkey", 20).select("p_partkey", "p_name")


@query("""
    SELECT p_partkey, prio, r FROM (SELECT *, row_number() OVER (ORDER BY prio, score DESC, p_partkey) AS r FROM (SELECT p_partkey, CASE WHEN p_size > 45 THEN 0 WHEN p_type = 'PROMO' THEN 1 ELSE 2 END AS prio, count(l_orderkey) AS score FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_size, p_type)) WHERE r <= 300
""")
def reduce_priority(spark, d):
    n = read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("score"))
    p = read(spark, d, "part").join(n, F.col("p_partkey") == F.col("l_partkey"), "left").select("p_partkey", F.when(F.col("p_size") > 45, 0).when(F.col("p_type") == "PROMO", 1).otherwise(2).alias("prio"), F.coalesce("score", F.lit(0)).alias("score"))
    top = p.orderBy("prio", F.desc("score"), "p_partkey").limit(300)
    return top.withColumn("r", F.row_number().over(Window.orderBy("prio", F.desc("score"), "p_partkey"))).select("p_partkey", "prio", "r")


@query("SELECT p_partkey, count(DISTINCT l_orderkey) AS score FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def centrality(spark, d):
    lines = read(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("owner"), F.concat(F.lit("uses part "), F.col("l_partkey").cast("string")).alias("text"))
    scores = graph.centrality(lines, read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name")))
    return scores.select(F.col("name").cast("long").alias("p_partkey"), "score")


@query("""
    WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), r AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT r.child, e.parent, depth + 1 FROM r JOIN e ON r.ancestor = e.child WHERE depth < 8)
    SELECT child, ancestor, min(depth) AS depth FROM r WHERE child <> ancestor GROUP BY ALL
""")
def recursive_closure(spark, d):
    return graph.closure(read(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent")))


MEMBERS = "e AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0), r AS (SELECT child, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT r.child, e.parent, depth + 1 FROM r JOIN e ON r.ancestor = e.child WHERE depth < 8), a AS (SELECT child, ancestor, min(depth) AS depth FROM r WHERE child <> ancestor GROUP BY ALL), m AS (SELECT DISTINCT p_partkey AS owner, w AS member FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part))"


def _family(spark, d):
    part = read(spark, d, "part")
    ancestry = graph.closure(part.where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent")))
    return part.select(F.col("p_partkey").alias("owner"), F.explode(F.split("p_name", " ")).alias("member")).distinct(), ancestry


@query(f"""
    WITH RECURSIVE {MEMBERS} SELECT owner, member, inherited_from
    FROM (SELECT child AS owner, m.member, ancestor AS inherited_from, row_number() OVER (PARTITION BY child, m.member
    ORDER BY depth, ancestor) AS n FROM a JOIN m ON m.owner = ancestor WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.owner = child
    AND o.member = m.member)) WHERE n = 1
""")
def inheritance(spark, d):
    return graph.inherited(*_family(spark, d))


@query(f"""
    WITH RECURSIVE {MEMBERS}, x AS (SELECT child AS owner, m.member, ancestor, depth, min(depth) OVER (PARTITION BY child, m.member) AS least
    FROM a JOIN m ON m.owner = ancestor WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.owner = child AND o.member = m.member))
    SELECT owner, member, min(ancestor) AS promoted_from FROM x WHERE depth = least GROUP BY ALL HAVING count(*) = 1
""")
def promotion(spark, d):
    return graph.promoted(*_family(spark, d))


@query("""
    WITH RECURSIVE s AS (SELECT p_partkey AS name, p_partkey // 2 AS defined_in FROM part WHERE p_partkey % 4 <> 1 AND p_partkey > 0),
    r AS (SELECT name, defined_in AS pt, 1 AS hop FROM s UNION ALL SELECT r.name, s.defined_in, hop + 1 FROM r JOIN s ON s.name = r.pt
    WHERE hop < 8) SELECT name, CASE WHEN arg_max(pt, hop) IN (SELECT name FROM s) THEN NULL ELSE arg_max(pt, hop) END AS definition
    FROM r GROUP BY name
""")
def definition_chain(spark, d):
    s = read(spark, d, "part").where("p_partkey % 4 <> 1 and p_partkey > 0").select(F.col("p_partkey").alias("name"), F.floor(F.col("p_partkey") / 2).alias("defined_in"))
    return graph.definitions(s)


@query()
def c3_order(spark, d):
    part = read(spark, d, "part").select("p_brand", F.concat(F.lit("C"), F.col("p_partkey").cast("string")).alias("name"), F.array_distinct(F.transform(F.array(F.floor(F.col("p_partkey") / 2), F.floor(F.col("p_partkey") / 3)), lambda x: F.concat(F.lit("C"), x.cast("string")))).alias("bases"))
    return graph.c3_orders(part.withColumn("bases", F.filter("bases", lambda b: b != F.col("name"))), "p_brand").select("p_brand", "name", F.array_join("order", ">").alias("order"))


@query("""
    WITH e AS (SELECT p_partkey::VARCHAR AS name, p_brand AS path, CASE WHEN p_size < 5 THEN 'Brand#' || (p_partkey % 30) END AS re FROM part), f AS (SELECT path, min(name) AS definition FROM e GROUP BY path)
    SELECT name AS shell, definition FROM e JOIN f ON f.path = re WHERE name <> definition
""")
def reexport_pairs(spark, d):
    part = read(spark, d, "part")
    e = part.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("import_path"), F.when(F.col("p_size") < 5, F.concat(F.lit("Brand#"), (F.col("p_partkey") % 30).cast("string"))).alias("reexport_of"), F.lit(1).alias("members"))
    return graph.reexports(e)


OLD_NEW = "o AS (SELECT p_partkey, p_name AS v FROM part WHERE p_partkey % 10 <> 1), n AS (SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN p_name || '!' ELSE p_name END AS v FROM part WHERE p_partkey % 10 <> 2)"


def _old_new(spark, d):
    part = read(spark, d, "part")
    return part.where("p_partkey % 10 <> 1").select("p_partkey", F.col("p_name").alias("v")), part.where("p_partkey % 10 <> 2").select("p_partkey", F.when(F.col("p_size") % 9 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")).alias("v"))


@query(f"""
    WITH {OLD_NEW} SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'added'
    WHEN n.p_partkey IS NULL THEN 'removed' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'identical' ELSE 'changed' END AS status
    FROM o FULL JOIN n USING (p_partkey)
""")
def generation_diff(spark, d):
    return diff.diff(*_old_new(spark, d), ["p_partkey"], "v")


@query(f"""
    WITH {OLD_NEW} SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.v IS NOT DISTINCT FROM n.v THEN 'identical'
    WHEN n.v IS NULL THEN 'lost' WHEN o.v IS NULL THEN 'new' ELSE 'changed' END AS status FROM o FULL JOIN n USING (p_partkey)
""")
def answer_diff(spark, d):
    old, new = _old_new(spark, d)
    return diff.answer_diff(old.withColumnRenamed("v", "answer"), new.withColumnRenamed("v", "answer"), "p_partkey")


@query(f"""
    WITH {OLD_NEW} SELECT v, 'old' AS side FROM (SELECT v FROM o EXCEPT ALL SELECT v FROM n) UNION ALL SELECT v, 'new' FROM (SELECT v
    FROM n EXCEPT ALL SELECT v FROM o)
""")
def multiset_diff(spark, d):
    old, new = _old_new(spark, d)
    return diff.multiset_difference(old.select("v"), new.select("v"))


@query(f"""
    WITH {NAMED} SELECT p_type, count(*) AS n, count(*) - count(DISTINCT name) AS duplicates, count(CASE
    WHEN trim(p_name) = '' THEN 1 END) AS empty FROM p GROUP BY p_type
""")
def kind_counts(spark, d):
    return parts(spark, d).groupBy("p_type").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("name")).alias("duplicates"), F.count(F.when(F.trim("p_name") == "", 1)).alias("empty"))


@query("""
    SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F, count(CASE
    WHEN o_orderstatus = 'O' THEN 1 END) AS O, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS P FROM orders GROUP BY 1
""")
def commit_counts_pivot(spark, d):
    return read(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("""
    SELECT kind, count(p_partkey) AS n FROM (SELECT unnest(['ECONOMY', 'PROMO', 'STANDARD', 'NONE']) AS kind) LEFT
    JOIN part ON p_type = kind GROUP BY kind
""")
def zero_filled_counts(spark, d):
    counts = read(spark, d, "part").groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))
    return quality.zero_filled(counts, spark, ("ECONOMY", "PROMO", "STANDARD", "NONE"))


LOG = "l AS (SELECT o_custkey::VARCHAR AS scope, strftime(o_orderdate, '%Y-%m-%d') AS ts, o_orderkey AS generation_id, o_orderkey % 11 = 0 AS override, o_orderkey % 100 AS symbols, o_custkey % 50 AS docs, o_orderkey % 7 AS examples FROM orders)"


@query(f"""
    WITH {LOG}, w AS (SELECT *, row_number() OVER x AS n, coalesce(sum(override::INT) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING
    AND 1 PRECEDING), 0) AS before FROM l WINDOW x AS (PARTITION BY scope ORDER BY ts DESC, generation_id DESC))
    SELECT scope, max(symbols) AS symbols, max(docs) AS docs, max(examples) AS examples FROM w WHERE n <= 3 AND before = 0
    GROUP BY scope
""")
def regression_baseline(spark, d):
    o = read(spark, d, "orders")
    log = o.select(F.col("o_custkey").cast("string").alias("scope"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ts"), F.col("o_orderkey").alias("generation_id"), (F.col("o_orderkey") % 11 == 0).alias("override"), (F.col("o_orderkey") % 100).alias("symbols"), (F.col("o_custkey") % 50).alias("docs"), (F.col("o_orderkey") % 7).alias("examples"), F.lit("published").alias("event"))
    return publish.baseline(log)


@query("""
    WITH m AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1997-01-01') AS old, count(*) AS now FROM orders
    WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1) SELECT o_custkey, old, now - old AS now, old > 0
    AND now - old < old * 0.8 AS refused FROM m
""")
def publish_policy(spark, d):
    o = read(spark, d, "orders").where("o_orderdate < timestamp_ntz'1998-01-01'").groupBy("o_custkey").agg(F.count(F.when(F.col("o_orderdate") < F.expr("timestamp_ntz'1997-01-01'"), 1)).alias("old"), F.count("*").alias("all"))
    return o.select("o_custkey", "old", (F.col("all") - F.col("old")).alias("now"), predicates.drops(F.col("old"), F.col("all") - F.col("old"), 0.2).alias("refused"))


@query("""
    SELECT scope, generation_id, n <= 3 OR active OR protected AS kept
    FROM (SELECT o_custkey AS scope, o_orderkey AS generation_id, o_orderkey % 50 = 0 AS active, o_orderpriority = '1-URGENT' AS protected, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
""")
def retention_keep_last(spark, d):
    g = read(spark, d, "orders").select(F.col("o_custkey").alias("scope"), F.col("o_orderkey").alias("generation_id"), F.col("o_orderdate").alias("version"), (F.col("o_orderkey") % 50 == 0).alias("active"), (F.col("o_orderpriority") == "1-URGENT").alias("protected"))
    return publish.retained(g).select("scope", "generation_id", "kept")


@query("""
    SELECT o_custkey, max(o_orderkey) FILTER (WHERE r = 1) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) GROUP BY 1
""")
def pointer_latest(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


VERSION = "'v' || (p_size % 4 + 1) || '.' || (p_partkey % 13) || CASE WHEN p_size % 2 = 0 THEN '.' || (p_partkey % 5) ELSE '' END"


def _tag():
    return F.concat(F.lit("v"), (F.col("p_size") % 4 + 1).cast("string"), F.lit("."), (F.col("p_partkey") % 13).cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("."), (F.col("p_partkey") % 5).cast("string"))).otherwise(""))


@query(f"""
    SELECT p_partkey, tag, CASE WHEN p_brand = 'Brand#1' THEN 'commit_equal' WHEN major = 2 AND (minor, patch) > (6, 3) THEN 'version_newer' WHEN major = 2 THEN 'version_not_newer' ELSE 'unknown' END AS basis,
      CASE WHEN p_brand = 'Brand#1' THEN true WHEN major = 2 THEN (minor, patch) <= (6, 3) END AS in_index
    FROM (SELECT p_partkey, p_brand, {VERSION} AS tag, p_size % 4 + 1 AS major, p_partkey % 13 AS minor, CASE WHEN p_size % 2 = 0 THEN p_partkey % 5 ELSE 0 END AS patch FROM part)
""")
def release_alignment(spark, d):
    a = versions.alignment("tag", F.col("p_brand"), F.lit("brand#1"), versions.parsed(F.lit("2.6.3")))
    return read(spark, d, "part").withColumn("tag", _tag()).select("p_partkey", "tag", a.alias("a")).select("p_partkey", "tag", "a.basis", "a.in_index")


@query(f"""
    SELECT p_partkey, CASE WHEN (a, b, c) < (2, 6, 0) THEN -1 WHEN (a, b, c) > (2, 6, 0) THEN 1 ELSE 0 END AS compared
    FROM (SELECT p_partkey, p_size % 4 + 1 AS a, p_partkey % 13 AS b, CASE WHEN p_size % 2 = 0 THEN p_partkey % 5 ELSE 0 END AS c
    FROM part)
""")
def version_compare(spark, d):
    return read(spark, d, "part").select("p_partkey", versions.compared(versions.parsed(_tag()), versions.parsed(F.lit("2.6"))).alias("compared"))


@query("""
    SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN 'unknown' WHEN p_size % 3 > 0 AND p_partkey % 3 > 0 THEN 'diverged'
        WHEN p_size % 3 > 0 THEN 'index_ahead_of_package' WHEN p_partkey % 3 > 0 THEN 'package_ahead_of_index' ELSE 'in_sync' END AS drift FROM part
""")
def drift_verdict(spark, d):
    """A count is missing on some parts and negative on others."""
    ahead = F.when(F.col("p_size") % 5 != 0, F.when(F.col("p_size") % 7 == 0, -1).otherwise(F.col("p_size") % 3))
    return read(spark, d, "part").select("p_partkey", versions.drift(ahead, F.col("p_partkey") % 3).alias("drift"))


#: Release notes, one for each remainder of p_size, with their verdicts; {} is the part's name.
NOTES = (
    ("  \n", "none"),
    ("**Full Changelog**: https://x/compare/v1...v2\n", "templated"),
    ("## What's Changed\n- Fixed `{}` for release 1.2.3", "detailed"),
    ("This release publishes version 1.2.3.", "templated"),
    ("## What’s changed\n* Fix `{}` by @dev-1 in https://x/pull/12\n* @dev-1 made their first contribution in #12\n## New Contributors", "templated"),
    ("Regressed `{}.bar` since the last one.", "detailed"),
    ("The indexes of {} synchronized: 1,204 rows.", "detailed"),
    ("Adds {} in 1.2 and 3.4.5.\n```\npip install `x` 1234\n```", "templated"),
)


@query("SELECT p_partkey, CASE p_size % 8 " + " ".join(f"WHEN {i} THEN '{verdict}'" for i, (_, verdict) in enumerate(NOTES)) + " END AS richness FROM part")
def richness(spark, d):
    """The verdict of a template follows from what it says; only the part's name in it differs."""
    body = functools.reduce(lambda a, x: F.when(F.col("p_size") % len(NOTES) == x[0], F.replace(F.lit(x[1][0]), F.lit("{}"), F.col("p_name"))).otherwise(a), enumerate(NOTES), F.lit(None).cast("string"))
    return read(spark, d, "part").select("p_partkey", versions.richness(body).alias("richness"))


@query("""
    WITH o AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 3 THEN '1996-03-15' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS asked,
                      CASE WHEN o_orderkey % 9 > 2 THEN CASE WHEN o_orderkey % 9 = 3 THEN '1996-03-15' ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS day FROM orders),
    r AS (SELECT unnest(['1995-06-01', '1996-03-15', '1998-01-01', '2000-12-31']) AS r),
    m AS (SELECT o_orderkey, any_value(asked) AS asked, any_value(day) AS day, max(r) FILTER (WHERE r <= day) AS fit, min(r) AS least, bool_or(r = day) AS exact FROM o, r GROUP BY o_orderkey)
    SELECT o_orderkey, CASE WHEN day IS NOT NULL THEN coalesce(fit, least) END AS revision,
           CASE WHEN day IS NULL THEN NULL WHEN exact THEN 'none' WHEN fit IS NULL THEN 'below_min_supported' ELSE 'unknown_revision' END AS fallback,
           CASE WHEN coalesce(trim(asked), '') = '' THEN 'missing' WHEN day IS NULL THEN 'malformed' END AS error FROM m
""")
def revision_negotiation(spark, d):
    """Some orders ask for no date, some for one that is none."""
    kind, day = F.col("o_orderkey") % 9, F.date_format("o_orderdate", "yyyy-MM-dd")
    asked = F.when(kind == 0, None).when(kind == 1, "  ").when(kind == 2, F.date_format("o_orderdate", "dd.MM.yyyy")).when(kind == 3, "1996-03-15").otherwise(day)
    supported = F.array(*map(F.lit, ("1995-06-01", "1996-03-15", "1998-01-01", "2000-12-31")))
    return read(spark, d, "orders").select("o_orderkey", versions.negotiated(asked, supported).alias("n")).select("o_orderkey", "n.revision", "n.fallback", "n.error")


@query("""
    SELECT event_type, le, count(CASE WHEN value <= le THEN 1 END) AS n
    FROM events, (SELECT unnest([0.5, 1.0, 2.5, 5.0, 10.0, 100.0])::DOUBLE AS le) GROUP BY ALL UNION ALL
    SELECT event_type, NULL, count(*) FROM events GROUP BY ALL
""")
def latency_histogram(spark, d):
    return quality.histogram(read(spark, d, "events"), ["event_type"], F.col("value"), (0.5, 1.0, 2.5, 5.0, 10.0, 100.0)).select("event_type", "le", "n")


@query("SELECT event_type, quantile_disc(value, 0.95) AS value FROM events GROUP BY 1")
def percentile_nearest_rank(spark, d):
    return quality.nearest_rank(read(spark, d, "events"), ["event_type"], "value", 0.95)


@query("""
    SELECT event_type, json_extract_string(props, '$.k')::INT % 10 AS code, count(*) AS n, count(*) FILTER (WHERE value > 100) AS misses
    FROM events GROUP BY ALL
""")
def miss_counters(spark, d):
    return read(spark, d, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("code")).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 100, 1)).alias("misses"))


@query("SELECT 'calls{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def exposition(spark, d):
    return quality.exposition(read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "calls", ["event_type"], "n")


@query("""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS stop, count(*) AS n FROM s GROUP BY user_id, k
""")
def sessions(spark, d):
    s = telemetry.sessions(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return s.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("stop").alias("stop"), "n")


@query("""
    SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start, count(*) AS n, round(sum(value), 6) AS total FROM events
    GROUP BY ALL
""")
def tumbling(spark, d):
    w = telemetry.windowed(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    return w.select("event_type", F.unix_micros("start").alias("start"), "n", "total")


@query("""
    SELECT event_type, epoch_us(time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR) AS start, count(*) AS n, round(sum(value),
    6) AS total FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL
""")
def sliding(spark, d):
    w = telemetry.windowed(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "12 hours", "6 hours")
    return w.select("event_type", F.unix_micros("start").alias("start"), "n", "total")


@query()
def breaker_states(spark, d):
    return telemetry.breaker_states(read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), failures=2, open_for=86_400.0).select("user_id", F.unix_micros("ts").alias("ts"))


@query("""
    SELECT coalesce(c_mktsegment, 'ALL') AS family, count(*) AS n, round(avg(CASE WHEN r BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END),
    6) AS hit_at_k, round(avg(CASE WHEN r >= 1 THEN 1.0 / r ELSE 0.0 END), 6) AS mrr, round(avg(CASE WHEN r = 0 THEN 1.0
    ELSE 0.0 END), 6) AS wrong_rate FROM (SELECT c_mktsegment, CASE WHEN c_custkey % 7 < 6 THEN c_custkey % 6 END AS r FROM customer)
    GROUP BY GROUPING SETS ((c_mktsegment), ())
""")
def mrr_rollup(spark, d):
    answers = read(spark, d, "customer").select(F.col("c_mktsegment").alias("family"), F.when(F.col("c_custkey") % 7 < 6, F.col("c_custkey") % 6).alias("r"))
    q = quality.retrieval_quality(answers, "family", "r")
    return q.select("family", "n", *(F.round(c, 6).alias(c) for c in ("hit_at_k", "mrr", "wrong_rate")))


@query("""
    SELECT n_regionkey, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer
    JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)
""")
def ledger_totals(spark, d):
    j = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_regionkey", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def cube_counts(spark, d):
    return read(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, d):
    return read(spark, d, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""
    SELECT o_custkey, o_orderkey, r AS rank, total_matches, CASE WHEN total_matches > 6 THEN 6 END AS next_offset
    FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS total_matches FROM orders)
    WHERE r BETWEEN 4 AND 6
""")
def topk_paging(spark, d):
    ranked = read(spark, d, "orders").withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return budget.page(ranked, "o_custkey", "rank", 3, 3).select("o_custkey", "o_orderkey", "rank", "total_matches", "next_offset")


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice),
    2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount),
    6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL
""")
def pricing_summary(spark, d):
    line = read(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'2000-09-02'")
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""
    SELECT n_name, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name
""")
def inner_joins(spark, d):
    t = lambda n: read(spark, d, n)
    j = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' GROUP BY 1")
def left_join(spark, d):
    o = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return read(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_join(spark, d):
    return read(spark, d, "customer").join(read(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
    SELECT coalesce(c.k, s.k) AS nationkey, n_customers, n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1) c
    FULL JOIN (SELECT s_nationkey + 3 AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) s ON c.k = s.k
""")
def full_join(spark, d):
    """Suppliers under another nation's key, so that either side has keys of its own."""
    c = read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    s = read(spark, d, "supplier").groupBy((F.col("s_nationkey") + 3).alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    return c.join(s, "nationkey", "full_outer")


@query("""
    SELECT o_orderkey, arg_max(e.event_id, (e.ts, e.event_id)) AS event_id
    FROM (SELECT o_orderkey, TIMESTAMP '2024-01-01' + (o_orderkey % 40000) * INTERVAL 1 MINUTE AS pt, o_orderkey % 150 AS u
    FROM orders) o JOIN events e ON e.user_id = u AND e.ts <= pt GROUP BY o_orderkey
""")
def as_of_join(spark, d):
    """The last event of a user at or before a time: both sides in one sorted walk, no pairs."""
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 150).alias("user_id"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(o_orderkey % 40000 as int), 0)").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit(1).alias("side"))
    e = read(spark, d, "events").select(F.lit(None).cast("long").alias("o_orderkey"), "user_id", "ts", "event_id", F.lit(0).alias("side"))
    order = Window.partitionBy("user_id").orderBy("ts", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return o.unionByName(e).withColumn("event_id", F.last("event_id", ignorenulls=True).over(order)).where("side = 1 and event_id is not null").select("o_orderkey", "event_id")


@query("""
    SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts
    AND b.ts <= a.ts + INTERVAL 2 HOUR GROUP BY a.event_id
""")
def range_join(spark, d):
    """Later events of a user within two hours: a range frame instead of a join."""
    frame = Window.partitionBy("user_id").orderBy("at").rangeBetween(1, 7_200_000_000)
    e = read(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return e.withColumn("n", F.count("*").over(frame)).where("n > 0").select("event_id", "n")


@query("""
    SELECT o_custkey, o_orderkey, rank() OVER w AS rank, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate, o_orderkey) AS tile, lag(o_orderkey) OVER (PARTITION BY o_custkey
    ORDER BY o_orderdate, o_orderkey) AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)
""")
def window_rank(spark, d):
    w, v = Window.partitionBy("o_custkey").orderBy("o_orderdate"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, d, "orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense"), F.ntile(4).over(v).alias("tile"), F.lag("o_orderkey").over(v).alias("before"))


@query("""
    (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation
    WHERE n_regionkey = 1 INTERSECT SELECT n_nationkey FROM nation
""")
def set_operations(spark, d):
    t = lambda n, c: read(spark, d, n).select(F.col(c).alias("k"))
    one = read(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"))
    return t("customer", "c_nationkey").union(t("supplier", "s_nationkey")).distinct().subtract(one.intersect(t("nation", "n_nationkey")))


@query(f"""
    WITH {NAMED}, w AS (SELECT p_partkey, unnest({O.symbol_words('name')}) AS word, generate_subscripts({O.symbol_words('name')}, 1) AS i
    FROM p), h AS (SELECT p_partkey, word, max((i = 1)::INT) AS t, max((i > 1)::INT) AS m FROM w
    WHERE word IN ('economy', 'ring', 'red') GROUP BY ALL) SELECT p_partkey AS entry, round(sum(CASE word WHEN 'red' THEN 0.5 ELSE
    CASE WHEN t = 1 THEN 2.0 ELSE 1.5 END + CASE WHEN t = 1 AND m = 1 THEN 0.5 ELSE 0.0 END END), 6) AS score FROM h
    GROUP BY p_partkey HAVING count(*) >= 1.8
""")
def evidence_ranking(spark, d):
    words = parts(spark, d).select(F.col("p_partkey").alias("entry"), F.posexplode(T.symbol_words("name")).alias("i", "word")).select("entry", "word", F.when(F.col("i") == 0, "type").otherwise("member").alias("place"))
    concepts = spark.createDataFrame([("a", "economy", 1.0, False), ("b", "ring", 1.0, False), ("c", "red", 1.0, True)], "concept string, word string, weight double, light boolean")
    return symbols.evidence(words, concepts)


@query()
def suggest_fuzzy(spark, d):
    names = read(spark, d, "part").select(F.col("p_name").alias("fqn"))
    asked = spark.createDataFrame([("small rong",), ("red wdget",), ("zzzz",)], "query string")
    return symbols.suggestions(asked, names).select("query", F.array_join("suggestions", "|").alias("suggestions"))


@query("""
    SELECT lower(w) AS name, list_aggregate(list_sort(list_distinct(list(p_brand || '.' || w))), 'string_agg', '|') AS owners
    FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1
""")
def member_index(spark, d):
    m = read(spark, d, "part").select(F.col("p_brand").alias("owner"), F.explode(F.split("p_name", " ")).alias("member"))
    return symbols.member_index(m).select("name", F.array_join("owners", "|").alias("owners"))


@query("SELECT p_type, count(DISTINCT p_partkey) AS n, true AS approx_ok FROM part GROUP BY p_type")
def approximate_distinct(spark, d):
    """The sketch is an aggregate of its own: next to a distinct count it would be kept for each pair of type and key."""
    part = read(spark, d, "part")
    a = part.groupBy("p_type").agg(F.approx_count_distinct("p_partkey", 0.02).alias("a"))
    n = part.select("p_type", "p_partkey").distinct().groupBy("p_type").agg(F.count("p_partkey").alias("n"))
    both = a.alias("a").join(n.alias("n"), F.col("a.p_type").eqNullSafe(F.col("n.p_type")))
    return both.select("a.p_type", "n", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("approx_ok"))
