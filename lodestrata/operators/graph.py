"""Graphs of names: centrality, transitive closure, inheritance, linearisation, promotion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import cut


def centrality(references: DataFrame, names: DataFrame, owner: str = "owner", text: str = "text", name: str = "name") -> DataFrame:
    """name, score: how many other owners' reference texts hold the name as a whole word; an owner may have many texts. Texts are
    cut into words once and joined by equality; no pattern runs over all pairs. Pairs of word and owner are dealt by both, so
    no task holds all of a common word, and the names are not broadcast."""
    words = references.select(owner, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\w+"), F.lit(0)))).alias("word"))
    met = words.where(F.col("word") != F.col(owner)).repartition("word", owner).distinct()
    hits = met.groupBy("word").agg(F.count("*").alias("n"))
    return names.select(name).distinct().join(hits.withColumnRenamed("word", name), name, "left").select(name, F.coalesce("n", F.lit(0)).alias("score"))


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", hops: int = 8) -> DataFrame:
    """child, ancestor, depth (the least) over at most `hops` steps; cycles end, and nothing is its own ancestor. Each step is
    worked out once, from the pairs that the step before it found, and the walk ends with the first that finds none."""
    step = cut(edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor")).where("child <> ancestor").distinct())
    found = front = step.withColumn("depth", F.lit(1))
    links = step.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("next"))
    for depth in range(2, hops + 1):
        after = front.join(links, "ancestor").select("child", F.col("next").alias("ancestor")).where("child <> ancestor").distinct()
        front = cut(after.join(found.select("child", "ancestor"), ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def definitions(shells: DataFrame, hops: int = 8) -> DataFrame:
    """name, definition for names that say where they are defined (name, defined_in): the end of the chain; null on a cycle or
    where the chain is longer."""
    now = shells.select("name", F.col("defined_in").alias("definition"))
    links = shells.select(F.col("name").alias("definition"), F.col("defined_in").alias("next"))
    for _ in range(hops - 1):
        now = now.join(links, "definition", "left").select("name", F.coalesce("next", "definition").alias("definition"))
    open_ = links.select("definition").withColumn("open", F.lit(True))
    return now.join(open_, "definition", "left").select("name", F.when(F.col("open").isNull(), F.col("definition")).alias("definition"))


def chain_ends(links: DataFrame) -> DataFrame:
    """node, end for links (node, next; one next for each node): where a chain stops, whatever its length. Chains that run in a
    circle, or into one, have no end. Each step doubles the way that is known, so a chain of n links takes log n of them."""
    now = cut(links.select("node", F.col("next").alias("at")).where("node <> next"))
    most = now.count()
    own = links.where("node = next").select(F.col("node").alias("at"))
    now = now.join(own, "at", "left_anti")
    done = 1
    while done <= most:
        ahead = now.select(F.col("node").alias("at"), F.col("at").alias("further"))
        after = now.join(ahead, "at", "left").select("node", F.coalesce("further", "at").alias("at"), F.col("further").isNotNull().alias("moved"))
        now, done = cut(after), done * 2
        if not now.where("moved").limit(1).count():
            break
        now = now.drop("moved")
    ends = now.select("node", F.col("at").alias("end"))
    return ends.join(links.select(F.col("node").alias("end")), "end", "left_anti").select("node", "end")


def inherited(members: DataFrame, ancestry: DataFrame) -> DataFrame:
    """owner, member, inherited_from: members of ancestors that the owner does not declare, each from the nearest one."""
    reach = ancestry.join(members.select(F.col("owner").alias("ancestor"), "member"), "ancestor").select(F.col("child").alias("owner"), "member", "ancestor", "depth")
    free = reach.join(members.select("owner", "member"), ["owner", "member"], "left_anti")
    nearest = Window.partitionBy("owner", "member").orderBy("depth", "ancestor")
    return free.withColumn("n", F.row_number().over(nearest)).where("n = 1").select("owner", "member", F.col("ancestor").alias("inherited_from"))


def promoted(members: DataFrame, embedding: DataFrame) -> DataFrame:
    """owner, member, promoted_from: members of embedded structures at the least depth; a name that two hold there is dropped."""
    reach = embedding.join(members.select(F.col("owner").alias("ancestor"), "member"), "ancestor").select(F.col("child").alias("owner"), "member", "ancestor", "depth")
    free = reach.join(members.select("owner", "member"), ["owner", "member"], "left_anti")
    level = Window.partitionBy("owner", "member")
    best = free.withColumn("least", F.min("depth").over(level)).where("depth = least")
    return best.withColumn("n", F.count("*").over(level)).where("n = 1").select("owner", "member", F.col("ancestor").alias("promoted_from"))


def c3(bases: dict[str, list[str]], name: str, known: dict[str, list[str]] | None = None) -> list[str]:
    """The C3 order of a class. Unknown bases stand for themselves. Where there is no such order, on a cycle or where bases
    disagree, the walk goes on with the first class that is left, so that every class is named once. `known` keeps the
    orders of classes that are worked out, so that each is merged once."""
    known = {} if known is None else known

    def merged(x: str) -> list[str]:
        own = [b for b in bases.get(x, []) if b != x]
        rest = [[z for z in known.get(b, [b]) if z != x] for b in own] + [own]
        out = [x]
        while rest := [one for one in rest if one]:
            behind = {z for one in rest for z in one[1:]}
            head = next((one[0] for one in rest if one[0] not in behind), rest[0][0])
            out.append(head)
            rest = [[z for z in one if z != head] for one in rest]
        return out

    todo, open_ = [name], set()
    while todo:  # bases first, without recursion
        x = todo[-1]
        missing = [b for b in bases.get(x, []) if b != x and b not in known and b not in open_] if x not in known else []
        if missing:
            open_.add(x)
            todo.append(missing[0])
            continue
        todo.pop()
        open_.discard(x)
        if x not in known:
            known[x] = merged(x)
    return known[name]


def c3_orders(classes: DataFrame, scope: str = "scope", name: str = "name", bases: str = "bases") -> DataFrame:
    """scope, name, order for classes (scope, name, bases) of each scope, which is one library."""
    kind = classes.schema[scope].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held = {n: list(b) if b is not None else [] for n, b in zip(rows[name], rows[bases], strict=True)}
        done: dict[str, list[str]] = {}
        return pd.DataFrame({scope: [key[0]] * len(held), name: list(held), "order": [c3(held, n, done) for n in held]})

    return classes.groupBy(scope).applyInPandas(run, f"{scope} {kind}, {name} string, `order` array<string>")


def reexports(entries: DataFrame) -> DataFrame:
    """shell, definition for entries (name, import_path, reexport_of): the first entry, by name, at the path that a shell
    re-exports; what is left pairs a member-less entry (members = 0) with the only one of its short name that has members."""
    first = entries.groupBy("import_path").agg(F.min("name").alias("definition"))
    explicit = entries.where("reexport_of is not null").select(F.col("name").alias("shell"), F.col("reexport_of").alias("import_path")).join(first, "import_path").where("shell <> definition").select("shell", "definition")
    short = F.element_at(F.split("name", r"\."), -1)
    full = entries.where("members > 0").groupBy(short.alias("short")).agg(F.count("*").alias("n"), F.min("name").alias("definition")).where("n = 1")
    bare = entries.where("members = 0 and reexport_of is null").select(F.col("name").alias("shell"), short.alias("short")).join(full, "short").select("shell", "definition")
    return explicit.unionByName(bare)


def stub_pairs(entries: DataFrame, paired: DataFrame | None = None) -> DataFrame:
    """shell, definition, basis: entries without members and the one entry that each stands for; two rules, in this order.

    package: a stub of an __init__.py file goes with the only entry of its name, below its package, that has members.
    name: a class or enum of a .py file goes with the only entry of its name and kind in .py files that has members.
    No entry of a test is a definition, nor is a shell, nor one that another name replaces (shadowed); a stub that replaces
    another (shadows) is no shell. entries: id, name, kind, import_path, file, members (their number), is_test, and shadows
    and shadowed where there are any; paired: shells and definitions that are known before.

    A package is a prefix of its entries' paths: these are exploded and joined by equality."""
    for flag in ("shadows", "shadowed"):
        if flag not in entries.columns:
            entries = entries.withColumn(flag, F.lit(False))
    known = paired.select(F.col("shell").alias("id")) if paired is not None else entries.limit(0).select("id")
    free = entries.join(known, "id", "left_anti")
    full = free.where("members > 0 AND NOT coalesce(is_test, false) AND NOT coalesce(shadowed, false)")
    stubs = free.where("members = 0 AND NOT coalesce(shadows, false)")
    package = F.regexp_replace("import_path", r"\.?[^.]*$", "")
    parts = F.split("import_path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    below = full.where(F.size(parts) > 1).select("name", F.col("id").alias("definition"), F.explode(above).alias("package"))
    alone = below.groupBy("package", "name").agg(F.count("*").alias("n"), F.min("definition").alias("definition")).where("n = 1")
    first = stubs.where(F.col("file").endswith("__init__.py")).select(F.col("id").alias("shell"), "name", package.alias("package")).where("package <> ''").join(alone, ["package", "name"]).select("shell", "definition", F.lit("package").alias("basis"))
    first = cut(first)
    only = full.where(F.col("file").endswith(".py")).groupBy("name", "kind").agg(F.count("*").alias("n"), F.min("id").alias("definition")).where("n = 1")
    rest = stubs.where(F.col("file").endswith(".py") & F.col("kind").isin("class", "enum")).select(F.col("id").alias("shell"), "name", "kind").join(first, "shell", "left_anti")
    return first.unionByName(rest.join(only, ["name", "kind"]).select("shell", "definition", F.lit("name").alias("basis")))


def identities(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """name, canonical_id, aliases, is_definition from re-export pairs: aliases are the shells of a definition."""
    shells = pairs.groupBy("definition").agg(F.array_sort(F.collect_set("shell")).alias("aliases"))
    to = pairs.groupBy("shell").agg(F.min("definition").alias("definition"))
    own = entries.select("name").distinct().join(to.withColumnRenamed("shell", "name"), "name", "left")
    own = own.select("name", F.coalesce("definition", "name").alias("canonical_id"), F.col("definition").isNull().alias("is_definition"))
    return own.join(shells.withColumnRenamed("definition", "canonical_id"), "canonical_id", "left").select("name", "canonical_id", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "is_definition")
