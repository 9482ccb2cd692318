"""Queries of what a repository holds: examples of its READMEs, its API surface and what cites it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrata.operators import claims, examples, manifests, surface_chunks
from lodestrata.operators.staging import shared_folder
from lodestrata.streaming import telemetry

from .catalog_text import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Documents as READMEs: each line is a fence, four lines are a block; every second block is an example block, and these come
#: first. Lines in turn import their first word before, after, or without code, or use it only.
LINES = """
    l AS (SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(replace(coalesce(text, ''), '`', ''''), chr(10)) AS x FROM documents)),
    w AS (SELECT doc_id, i, i // 4 AS block, i // 4 % 2 AS side, 'use ' || line AS used, 'import ' || regexp_extract(line, '[A-Za-z]+') AS one, 'from ' || regexp_extract(line, '[A-Za-z]+') || ' import x' AS two, regexp_extract(line, '[A-Za-z]+') AS word FROM l),
    c AS (SELECT *, CASE i % 5 WHEN 0 THEN concat(one, chr(10), used) WHEN 1 THEN used WHEN 2 THEN concat(used, chr(10), two) WHEN 3 THEN concat('# x', chr(10), one) ELSE word END AS raw,
          CASE WHEN word <> '' AND i % 5 IN (0, 2, 3) THEN word END AS key, CASE WHEN i % 5 = 2 THEN two ELSE one END AS unit FROM w WHERE i % 7 <> 6 AND i % 11 <> 10),
    n AS (SELECT *, regexp_replace(raw, '[ \t]+(\n|$)', '\\1', 'g') AS code, row_number() OVER (PARTITION BY doc_id, block ORDER BY i) AS part FROM c),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY side, i) AS copy FROM n) WHERE copy = 1),
    t AS (SELECT *, 'Block' || block % 3 || CASE WHEN part > 1 THEN ' (part ' || part || ')' ELSE '' END AS title, key IS NOT NULL AND i % 5 <> 2 AS starts,
          CASE WHEN side = 0 THEN -1 ELSE block END AS chain FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY side, i) - 1 AS place, row_number() OVER (PARTITION BY doc_id, title ORDER BY side, i) AS nth,
          sum(starts::INT) OVER (PARTITION BY doc_id, chain ORDER BY i) AS run FROM t)
"""


@query(f"""
    WITH {LINES},
    u AS (SELECT doc_id, chain, run, key, min({{'i': i, 'unit': unit}}) AS first FROM r WHERE key IS NOT NULL GROUP BY ALL),
    p AS (SELECT r.doc_id, r.i, string_agg(u.first.unit, chr(10) ORDER BY u.first.i) AS prefix FROM r JOIN u ON u.doc_id = r.doc_id AND u.chain = r.chain AND u.run = r.run AND u.first.i < r.i AND u.key IS DISTINCT FROM r.key WHERE NOT r.starts GROUP BY ALL)
    SELECT doc_id, place, title || CASE WHEN nth > 1 THEN ' (' || nth || ')' ELSE '' END AS title, 'Line ' || i AS description, sha256(code) AS code_sha256, starts AS starts_example,
      key IS NOT NULL AND i % 5 = 3 AS imports_only, coalesce(prefix, '') AS import_prefix FROM r LEFT JOIN p USING (doc_id, i)
""")
def readme_examples(spark, d):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("`"), F.lit("'"))
    word = lambda x: F.regexp_extract(x, "[A-Za-z]+", 0)
    use = lambda x: F.concat(F.lit("use "), x)
    one = lambda x: F.concat(F.lit("import "), word(x))
    made = lambda x, i: F.when(i % 5 == 0, F.concat_ws("\n", one(x), use(x))).when(i % 5 == 1, use(x)).when(i % 5 == 2, F.concat(use(x), F.lit("\nfrom "), word(x), F.lit(" import x"))).when(i % 5 == 3, F.concat(F.lit("# x\n"), one(x))).otherwise(word(x))
    cut = lambda i: F.when(i % 11 == 10, F.lit('\nload("data:image/png;base64,iVBORw0KGgo...")')).otherwise("")
    fence = lambda x, i: F.concat(F.lit("Line "), i.cast("string"), F.when(i % 7 == 6, "\n```text\n").otherwise("\n```{.python}\n"), made(x, i), cut(i), F.lit("\n```\n"))
    lined = read(spark, d, "documents").select("doc_id", F.split(text, "\n").alias("lines")).select("doc_id", F.transform("lines", fence).alias("fences"))
    block = lambda n: F.struct(F.concat(F.lit("Block"), (n % 3).cast("string")).alias("title"), F.array_join(F.slice("fences", n * 4 + 1, 4), "").alias("content"))
    none = F.lit(None).cast("string")
    numbers = F.sequence(F.lit(0), F.floor((F.size("fences") - 1) / 4).cast("int"))
    single = F.transform(F.filter(numbers, lambda n: n % 2 == 0), block)
    content = F.transform(F.filter(numbers, lambda n: n % 2 == 1), lambda n: F.struct(block(n)["title"].alias("title_left"), block(n)["content"].alias("content_left"), none.alias("title_right"), none.alias("content_right")))
    pages = lined.select("doc_id", examples.fields(single, content).alias("fields"))
    rows = examples.candidates(pages, "python", key="doc_id")
    return rows.select("doc_id", "place", "title", "description", "code_sha256", "starts_example", "imports_only", F.array_join("import_prefix", "\n").alias("import_prefix"))


#: Parts as the surfaces of five libraries: a quarter are stubs of a package, the others have the words of their names
#: as methods and their size as a property; two of three parts share a name.
SURFACE = """
    e AS (SELECT 'M' || p_partkey % 5 AS scope, p_partkey AS ord, 'N' || (p_partkey // 12) AS name, CASE WHEN p_size % 2 = 0 THEN 'class' ELSE 'enum' END AS kind, p_size % 4 = 0 AS stub,
        'pkg.' || lower(split_part(p_type, ' ', 1)) || CASE WHEN p_size % 4 = 0 THEN '' ELSE '.' || lower(split_part(p_type, ' ', 2)) END AS space, p_name, p_size, p_brand, p_size % 10 = 9 AS old,
        CASE WHEN p_size % 4 = 0 THEN 'pkg/__init__.py' ELSE 'pkg/part' || p_size % 3 || '.py' END AS file FROM part WHERE p_size % 13 <> 0),
    c AS (SELECT *, space || '.' || name AS path, NOT stub AS whole FROM e),
    u AS (SELECT s.scope, s.ord, min(d.ord) AS definition FROM c s JOIN c d ON d.scope = s.scope AND d.name = s.name AND d.whole AND starts_with(d.path, s.space || '.') WHERE s.stub GROUP BY ALL HAVING count(*) = 1),
    f AS (SELECT scope, name, kind, min(ord) AS definition FROM c WHERE whole GROUP BY ALL HAVING count(*) = 1),
    p AS (SELECT scope, ord, definition FROM u UNION ALL SELECT c.scope, c.ord, f.definition FROM c JOIN f USING (scope, name, kind) WHERE c.stub AND (c.scope, c.ord) NOT IN (SELECT (scope, ord) FROM u)),
    g AS (SELECT c.*, p.definition, coalesce(p.definition, c.ord) AS head FROM c LEFT JOIN p USING (scope, ord)),
    h AS (SELECT *, min(ord) OVER (PARTITION BY scope, head) AS unit FROM g),
    k AS (SELECT h.* FROM h JOIN (SELECT scope, unit, row_number() OVER (PARTITION BY scope ORDER BY unit) AS n FROM (SELECT DISTINCT scope, unit FROM h)) USING (scope, unit) WHERE n <= {most}),
    m AS (SELECT scope, count(*) FILTER (definition IS NULL) AS total FROM h GROUP BY scope), o AS (SELECT scope, count(*) FILTER (definition IS NULL) AS kept FROM k GROUP BY scope),
    q1 AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ord) - 1 AS place, CASE WHEN count(*) OVER (PARTITION BY scope, path) > 1 THEN regexp_extract(file, '([^/]*)[.]py$', 1) || '.' || name ELSE path END AS one FROM k),
    q2 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY scope, one) > 1 THEN one || '@' || coalesce(CASE WHEN p_size % 5 > 0 THEN p_size END, place) ELSE one END AS two FROM q1),
    q3 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY scope, two ORDER BY ord) > 1 THEN two || '#' || row_number() OVER (PARTITION BY scope, two ORDER BY ord) ELSE two END AS fqn FROM q2)
"""


def surface(spark, d):
    part = read(spark, d, "part")
    word = lambda n: F.lower(F.split_part("p_type", F.lit(" "), F.lit(n)))
    size = F.col("p_size")
    name = F.concat(F.lit("N"), F.floor(F.col("p_partkey") / 12).cast("string"))
    space = F.concat(F.lit("pkg."), word(1), F.when(size % 4 == 0, "").otherwise(F.concat(F.lit("."), word(2))))
    method = lambda w: F.struct(w.alias("name"), F.array(F.struct(F.lit("n").alias("name"), F.lit("int").alias("type"))).alias("params"), F.lit("str").alias("return_type"))
    file = F.when(size % 13 == 0, "tests/test_part.py").when(size % 4 == 0, "pkg/__init__.py").otherwise(F.concat(F.lit("pkg/part"), (size % 3).cast("string"), F.lit(".py")))
    whole = lambda x: F.when(size % 4 != 0, x)
    return part.select(
        F.concat(F.lit("M"), (F.col("p_partkey") % 5).cast("string")).alias("scope"), F.col("p_partkey").alias("ord"), name.alias("name"), F.when(size % 2 == 0, "class").otherwise("enum").alias("kind"), file.alias("file"), F.when(size % 5 > 0, size).alias("line"),
        F.concat_ws(".", space, name).alias("class_import"), space.alias("canonical_namespace"), whole(F.transform(F.split("p_name", " "), method)).alias("methods"),
        whole(F.array(F.struct(F.lit("size").alias("name"), F.lit("int").alias("type"), size.cast("string").alias("value")))).alias("properties"), (size % 10 == 9).alias("deprecated"), F.col("p_brand").alias("deprecated_reason"),
    )


@query(f"""
    WITH {SURFACE.format(most=surface_chunks.FIRST_TYPES)},
    w AS (SELECT scope, ord, string_agg('  - ' || word || '(n: int) -> str', chr(10) ORDER BY i) AS lines FROM (SELECT scope, ord, word, min(i) AS i FROM (SELECT scope, ord, unnest(x) AS word, generate_subscripts(x, 1) AS i FROM (SELECT scope, ord, string_split(p_name, ' ') AS x FROM q3 WHERE whole)) GROUP BY ALL) GROUP BY ALL),
    s AS (SELECT scope, definition AS ord, string_agg('Exported-As: ' || fqn, chr(10) ORDER BY ord) AS shown FROM q3 WHERE definition IS NOT NULL GROUP BY ALL)
    SELECT q3.scope, q3.ord, q3.fqn, q3.fqn || CASE WHEN q3.old THEN ' (deprecated: ' || q3.p_brand || ')' ELSE '' END AS section_title, t.fqn AS definition,
      concat_ws(chr(10), 'FQN: ' || q3.fqn, 'Kind: ' || q3.kind, CASE WHEN q3.old THEN 'Deprecated: ' || q3.p_brand END, 'Defined-In: ' || t.fqn, shown,
        CASE WHEN q3.whole THEN concat(chr(10), 'Methods:', chr(10), lines, chr(10), chr(10), 'Properties:', chr(10), '  - size: int = ', q3.p_size) END, concat(chr(10), 'API-Coverage: ', o.kept, ' of ', m.total, ' types')) AS text
    FROM q3 LEFT JOIN q3 t ON t.scope = q3.scope AND t.ord = q3.definition LEFT JOIN w ON w.scope = q3.scope AND w.ord = q3.ord LEFT JOIN s ON s.scope = q3.scope AND s.ord = q3.ord JOIN m ON m.scope = q3.scope JOIN o ON o.scope = q3.scope
""")
def symbol_chunks(spark, d):
    return surface_chunks.symbol_chunks(surface(spark, d), ["scope"])


#: What each part cites: types, members, namespaces, words, files, versions and what is not there.
CITED = """
    x AS (SELECT scope, ord, space, name, path, CASE WHEN whole THEN list_concat([''], list_transform(list_distinct(list_concat(string_split(p_name, ' '), ['size'])), lambda y: '.' || y)) ELSE [''] END AS ends FROM (
            SELECT *, p_size % 4 <> 0 AS whole, 'N' || (p_partkey // 12) AS name, space || '.N' || (p_partkey // 12) AS path, 'M' || p_partkey % 5 AS scope, p_partkey AS ord FROM (SELECT *, 'pkg.' || lower(split_part(p_type, ' ', 1)) || CASE WHEN p_size % 4 = 0 THEN '' ELSE '.' || lower(split_part(p_type, ' ', 2)) END AS space FROM part))),
    y AS (SELECT scope, ord, space, name, path, unnest(ends) AS tail FROM x),
    f AS (SELECT scope, name || tail AS anchor, ord FROM y UNION SELECT scope, path || tail, ord FROM y),
    n AS (SELECT DISTINCT scope, unnest([split_part(space, '.', 1), split_part(space, '.', 1) || '.' || split_part(space, '.', 2), space]) AS anchor FROM x),
    a AS (SELECT scope, anchor, count(*) AS n FROM f GROUP BY ALL),
    b AS (SELECT scope, regexp_extract(anchor, '[^.]*$') AS last, count(DISTINCT anchor) AS ends FROM f WHERE anchor LIKE '%.%' GROUP BY ALL),
    c0 AS (SELECT p_partkey, 'M' || p_partkey % 5 AS scope, unnest(spans) AS span, generate_subscripts(spans, 1) AS i FROM (SELECT p_partkey, ['N' || (p_partkey // 12), 'N' || (p_partkey // 12) || '.size()', 'pkg.' || lower(split_part(p_type, ' ', 1)),
        split_part(p_name, ' ', 1), split_part(p_name, ' ', 1) || '.py', 'v' || p_size || '.0', 'net' || p_size || '.0', 'N' || p_partkey || '.none(x)'] AS spans FROM part)),
    c1 AS (SELECT *, regexp_replace(span, '[(].*[)]$', '') AS anchor FROM c0),
    c AS (SELECT DISTINCT scope, anchor FROM c1),
    r AS (SELECT c.scope, c.anchor, coalesce(a.n, 0) AS n, CASE WHEN a.n IS NOT NULL OR (c.scope, c.anchor) IN (SELECT (scope, anchor) FROM n) OR (c.anchor NOT LIKE '%.%' AND ends = 1) THEN 'symbol'
      WHEN c.anchor LIKE '%.py' OR regexp_matches(c.anchor, '^(v|net)[0-9]') THEN 'non_symbol' ELSE 'unresolved' END AS class
      FROM c LEFT JOIN a USING (scope, anchor) LEFT JOIN b ON b.scope = c.scope AND b.last = c.anchor)
"""


def anchor_index(spark, d):
    return surface_chunks.AnchorIndex.build(surface_chunks.anchor_forms(surface(spark, d), ["scope"]), f"{shared_folder(spark)}/anchors-{uuid.uuid4().hex}", ["scope"])


def prose(spark, d):
    key, size, first = F.col("p_partkey"), F.col("p_size").cast("string"), F.split_part("p_name", F.lit(" "), F.lit(1))
    name = F.concat(F.lit("N"), F.floor(key / 12).cast("string"))
    span = lambda *x: F.concat(F.lit(" `"), *(F.lit(y) if isinstance(y, str) else y for y in x), F.lit("`"))
    said = F.concat(F.lit("See"), span(name), span(name, ".size()"), span("pkg.", F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))), span(first), span(first, ".py"), span("v", size, ".0"), span("net", size, ".0"), span("N", key.cast("string"), ".none(x)"))
    fenced = F.concat(F.lit(" `not one`\n```\n"), span("N", key.cast("string"), ".none(x)"), F.lit("\n```"))
    return read(spark, d, "part").select("p_partkey", F.concat(F.lit("M"), (key % 5).cast("string")).alias("scope"), F.concat(said, fenced).alias("text"))


@query(f"WITH {CITED} SELECT * FROM r")
def cited_anchors(spark, d):
    cited = prose(spark, d).select("scope", F.explode(claims.anchors("text")).alias("anchor"))
    return anchor_index(spark, d).classified(cited)


@query(f"""
    WITH {CITED}
    SELECT c1.p_partkey, count(*) FILTER (class = 'unresolved') AS neutralised,
      md5(concat('See', string_agg(CASE WHEN class = 'unresolved' THEN ' ' || span ELSE ' `' || span || '`' END, '' ORDER BY i), ' `not one`', chr(10), '```', chr(10), ' `N', c1.p_partkey, '.none(x)`', chr(10), '```')) AS text_md5
    FROM c1 JOIN r USING (scope, anchor) GROUP BY c1.p_partkey
""")
def neutralised_prose(spark, d):
    return anchor_index(spark, d).neutralised(prose(spark, d), "p_partkey").select("p_partkey", F.col("neutralised").cast("long").alias("neutralised"), F.md5("text").alias("text_md5"))


#: Each part as a source file of its brand's repository; every seventh size adds a project in one of the folders above it.
TREE = """
    s AS (SELECT p_brand AS repository, lower(replace(p_type, ' ', '/')) AS folder, p_partkey, p_size, lower(replace(p_type, ' ', '/')) || '/f' || p_partkey || '.cs' AS path FROM part),
    m AS (SELECT repository, p_size, CASE WHEN p_size % 4 = 0 THEN '' ELSE array_to_string(list_slice(string_split(folder, '/'), 1, CASE p_size % 4 WHEN 3 THEN 9 ELSE p_size % 4 END), '/') || '/' END AS under, 'lib' || p_partkey || '.csproj' AS file FROM s WHERE p_size % 7 = 0),
    g AS (SELECT repository, under, min(under || file) AS manifest FROM m GROUP BY ALL)
"""


def tree(spark, d):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    part = read(spark, d, "part").select(F.col("p_brand").alias("repository"), F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))).alias("folder"), key.alias("key"), size.alias("size"))
    under = F.when(F.col("size") % 4 == 3, F.col("folder")).otherwise(F.array_join(F.slice(F.split("folder", "/"), F.lit(1), F.col("size") % 4), "/"))
    sources = part.select("repository", F.concat("folder", F.lit("/f"), "key", F.lit(".cs")).alias("path"), "size")
    projects = part.where("size % 7 = 0").select("repository", F.concat_ws("/", F.nullif(under, F.lit("")), F.concat(F.lit("lib"), "key", F.lit(".csproj"))).alias("path"), "size")
    return sources, projects


@query(f"""
    WITH {TREE}, a AS (SELECT repository, path, unnest(list_transform(range(0, len(string_split(folder, '/')) + 1), lambda k: CASE WHEN k = 0 THEN '' ELSE array_to_string(list_slice(string_split(folder, '/'), 1, k), '/') || '/' END)) AS under FROM s)
    SELECT s.repository, s.path, max_by(manifest, length(g.under)) AS manifest FROM s JOIN a USING (repository, path) LEFT JOIN g USING (repository, under) GROUP BY ALL
""")
def nearest_manifests(spark, d):
    sources, projects = tree(spark, d)
    return manifests.of_sources(sources.select("repository", "path"), projects, platform="dotnet")


@query(f"""
    WITH {TREE},
    b AS (SELECT repository, min({{'depth': length(under) - length(replace(under, '/', '')), 'path': under || file, 'size': p_size}}) AS x FROM m GROUP BY ALL)
    SELECT repository, 'dotnet' AS platform, x.path AS path, CASE x.size % 3 WHEN 0 THEN 'netstandard2.0' WHEN 1 THEN 'net' || x.size % 5 + 5 || '.0' ELSE 'net48' END AS lowest FROM b
""")
def repository_manifests(spark, d):
    _, projects = tree(spark, d)
    size = F.col("size")
    several = F.when(size % 3 == 0, "net8.0; netstandard2.0;net48").when(size % 3 == 1, F.concat(F.lit("net48;net"), (size % 5 + 5).cast("string"), F.lit(".0"))).otherwise("net48;net472")
    texts = projects.select("repository", "path", F.concat(F.lit("<Project><TargetFrameworks>"), several, F.lit("</TargetFrameworks></Project>")).alias("text"))
    return manifests.of_repository(projects).join(texts, ["repository", "path"]).select("repository", "platform", "path", manifests.frameworks("text")["lowest"].alias("lowest"))


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


@query("""
    SELECT e.user_id, epoch_us(e.ts) AS asked_at, epoch_us(p.ts) AS answered_at FROM events e JOIN events p
      ON p.user_id = e.user_id AND e.event_type = 'error' AND p.event_type = 'purchase' AND p.ts BETWEEN e.ts AND e.ts + INTERVAL 6 HOUR
""")
def stream_join(spark, d):
    """Purchases in the six hours after a user's error, as a join of two streams into a table that holds each batch once."""
    side = lambda kind: telemetry.stream(spark, d, EVENTS, "events.parquet").where(F.col("event_type") == kind)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    table = telemetry.exactly_once(telemetry.matched(side("error"), side("purchase"), "user_id", "6 HOURS"), f"{folder}/table", f"{folder}/checkpoint")
    return table.select("user_id", F.unix_micros("asked_at").alias("asked_at"), F.unix_micros("answered_at").alias("answered_at"))
