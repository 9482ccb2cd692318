"""What a library's modules export: names along public uses, renames and wildcards, and the paths by which they are imported.

Everything is an edge of a graph that equality joins walk. A name of a module has a target: an item, or another module. A use
is a path that is walked a segment a step, each a lookup among the names of the module that was reached; its end gives its
module a name (under the bound name), or, as a wildcard, all public names of the module at its end, now and whenever that
module gains one. Names travel along wildcards last: what grows is the pairs of a module and one whose own public names it
takes, which are narrower and fewer than the names. Walks and pairs grow in turn until nothing new is found; each step joins
what is new only, and what a small step finds is looked up in what is known without a shuffle of that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import cut, shared_folder

#: A module's own name; an open path: the module it is used in, the bound name, the module that was reached (target) and the
#: segments that are left; a link: a wildcard's module and the one it takes from, or a module and one whose own public names
#: come to it. public says whether others see what it gives.
NAME = "scope string, module string, name string, kind string, target string, item string, public boolean"
PATH = "scope string, module string, name string, target string, rest array<string>, public boolean"
LINK = "scope string, module string, target string, public boolean"
HOP = "scope string, module string, name string, public boolean, rest array<string>, k string, t string, i string"


class _Facts:
    """Facts of one kind, as Parquet in the shared folder: each is written once, by the step that found it."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema, self.steps, self.found = spark, folder, schema, [], 0

    def staged(self, df: DataFrame) -> str:
        at, self.found = f"{self.folder}/{self.found}", self.found + 1
        df.write.parquet(at)
        return at

    def read(self, steps: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*steps) if steps else self.spark.createDataFrame([], self.schema)

    def all(self) -> DataFrame:
        return self.read(self.steps)

    def add(self, found: DataFrame) -> DataFrame | None:
        """The facts of found that are not known yet, from now on known; None if there are none. Nulls are values."""
        at = self.staged(found.distinct())
        if self.steps and not self.read([at]).isEmpty():
            own = self.read([at])
            same = lambda a, b: [F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in own.columns]
            named = lambda df, mark: df.select(*(F.col(c).alias(f"{mark}{c}") for c in own.columns))
            held = named(self.all(), "known_").join(named(own, "asked_"), same("known_", "asked_"), "left_semi")
            at = self.staged(own.join(held, same("", "known_"), "left_anti"))
        if self.read([at]).isEmpty():
            return None
        self.steps.append(at)
        return self.read([at])


def _both(one: DataFrame | None, other: DataFrame | None) -> DataFrame | None:
    return one if other is None else other if one is None else one.unionByName(other)


def _own(modules: DataFrame, items: DataFrame) -> DataFrame:
    """The names that modules have of themselves."""
    none, c = F.lit(None).cast("string"), F.col
    children = modules.where("parent IS NOT NULL").select("scope", c("parent").alias("module"), "name", F.lit("module").alias("kind"), c("module").alias("target"), none.alias("item"), "public")
    return children.where("name IS NOT NULL").unionByName(items.select("scope", "module", "name", F.lit("item").alias("kind"), c("module").alias("target"), c("name").alias("item"), "public"))


def _taken(links: DataFrame, own: DataFrame) -> DataFrame:
    """The names that come along links: the public ones of their targets."""
    given = own.where("public").select("scope", F.col("module").alias("target"), "name", "kind", F.col("target").alias("t"), "item")
    return links.join(given, ["scope", "target"]).select("scope", "module", "name", "kind", F.col("t").alias("target"), "item", "public")


def _hops(paths: DataFrame, names: DataFrame) -> DataFrame:
    """Where the next segment of open paths leads among names."""
    given = names.select("scope", F.col("module").alias("target"), F.col("name").alias("segment"), F.col("kind").alias("k"), F.col("target").alias("t"), F.col("item").alias("i"))
    return paths.withColumn("segment", F.get("rest", 0)).join(given, ["scope", "target", "segment"]).select("scope", "module", "name", "public", "rest", "k", "t", "i")


def _fixed_hops(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """Where the next segment leads if it is crate, self or super, which are private names of every module."""
    at = lambda word: paths.where(F.get("rest", 0) == word)
    held = modules.select("scope", F.col("module").alias("target"), "parent")
    roots = modules.where("parent IS NULL").select("scope", F.col("module").alias("root")).distinct()
    there = at("self").join(held.select("scope", "target"), ["scope", "target"], "left_semi").withColumn("t", F.col("target"))
    there = there.unionByName(at("super").join(held.where("parent IS NOT NULL"), ["scope", "target"]).withColumnRenamed("parent", "t"))
    there = there.unionByName(at("crate").join(held.select("scope", "target"), ["scope", "target"], "left_semi").join(roots, "scope").withColumnRenamed("root", "t"))
    return there.select("scope", "module", "name", "public", "rest", F.lit("module").alias("k"), "t", F.lit(None).cast("string").alias("i"))


def resolved_names(modules: DataFrame, items: DataFrame, uses: DataFrame) -> DataFrame:
    """scope, module, name, kind, target, item, public: every name of every module with all its targets. kind is module, and
    target the module; or item, and target and item where it is declared.

    modules: scope, module, parent (null for a root), name, public. items: scope, module, name, public. uses: scope, module,
    path (array of segments, which begin at the module; crate, self and super as they are), bound (null for a wildcard),
    public. A name may have several targets; a path that leads nowhere gives none; uses that lead to each other end. A row
    whose scope, module or name is null is no module, item or use."""
    known = lambda df, *columns: df.where(" AND ".join(f"{c} IS NOT NULL" for c in ("scope", *columns))).withColumn("public", F.coalesce("public", F.lit(False)))
    modules, items, uses = known(modules, "module"), known(items, "module", "name"), known(uses, "module", "path")
    spark, folder = modules.sparkSession, f"{shared_folder(modules.sparkSession)}/exports-{uuid.uuid4().hex}"
    own, paths, wild, links = (_Facts(spark, f"{folder}/{name}", schema) for name, schema in (("own", NAME), ("paths", PATH), ("wild", LINK), ("links", LINK)))
    hops = _Facts(spark, f"{folder}/hops", HOP)
    named = own.add(_own(modules, items))
    open_ = paths.add(uses.where(F.size("path") > 0).select("scope", "module", F.col("bound").alias("name"), F.col("module").alias("target"), F.col("path").alias("rest"), "public"))
    fresh, globs = named, None  # the names and wildcards that links have not met
    while True:
        while open_ is not None or (named is not None and paths.steps):
            met = None if named is None else _hops(paths.all(), named)
            if open_ is not None:
                met = _both(met, _fixed_hops(open_, modules).unionByName(_hops(open_, _names(own, links))))
            met = hops.read([hops.staged(met)])
            ends, module = F.size("rest") == 1, F.col("k") == "module"
            open_ = paths.add(met.where(~ends & module).select("scope", "module", "name", F.col("t").alias("target"), F.slice("rest", 2, 1 << 20).alias("rest"), "public"))
            globs = _both(globs, wild.add(met.where(ends & module & F.col("name").isNull()).select("scope", "module", F.col("t").alias("target"), "public")))
            gained = own.add(met.where(ends & F.col("name").isNotNull()).select("scope", "module", "name", F.col("k").alias("kind"), F.col("t").alias("target"), F.col("i").alias("item"), "public"))
            fresh = _both(fresh, gained)
            named = gained if gained is None or not links.steps else gained.unionByName(_taken(links.all(), gained))
        found = _linked(own, wild, links, fresh, globs)
        fresh = globs = None
        if found is None:
            return _names(own, links).distinct().where(~F.col("name").isin("crate", "self", "super"))
        named = _taken(found, own.all())


def _names(own: _Facts, links: _Facts) -> DataFrame:
    """All names that modules have by now; some of them repeat."""
    return own.all().unionByName(_taken(links.all(), own.all())) if links.steps else own.all()


def _linked(own: _Facts, wild: _Facts, links: _Facts, fresh: DataFrame | None, globs: DataFrame | None) -> DataFrame | None:
    """The new links after some new names and wildcards: a module takes from another that has own public names, by a wildcard or
    along a chain of which all but the first are public."""
    if not wild.steps:
        return None
    holds = lambda df, names: df.join(names.where("public").select("scope", F.col("module").alias("target")), ["scope", "target"], "left_semi")
    after = lambda df, more: df.join(more.where("public").select("scope", F.col("module").alias("target"), F.col("target").alias("end")), ["scope", "target"]).select("scope", "module", F.col("end").alias("target"), "public")
    found = None if fresh is None else holds(wild.all(), fresh)
    if globs is not None:
        found = _both(found, holds(globs, own.all()))
        found = found.unionByName(after(globs, links.all())) if links.steps else found
    done = len(links.steps)
    new = None if found is None else links.add(found)
    while new is not None:
        new = links.add(after(wild.all(), new))
    return links.read(links.steps[done:]) if len(links.steps) > done else None


def surface(modules: DataFrame, items: DataFrame, uses: DataFrame) -> DataFrame:
    """scope, module, item, path: what others can import, where it is declared, and the shortest path from a root, the first
    in the order of its segments of several. Only public names lead there. Inputs: as resolved_names.

    Modules are reached level by level, each by its best path: what is in it is best imported by that."""
    public = cut(resolved_names(modules, items, uses).where("public").select("scope", "module", "name", "kind", "target", "item"))
    front = modules.where("scope IS NOT NULL AND module IS NOT NULL AND parent IS NULL").select("scope", "module", F.array().cast("array<string>").alias("path")).distinct()
    reached = front = cut(front)
    while not front.isEmpty():
        after = front.join(public.where("kind = 'module'"), ["scope", "module"]).groupBy("scope", "target").agg(F.min(F.array_append("path", F.col("name"))).alias("path"))
        front = cut(after.withColumnRenamed("target", "module").join(reached.select("scope", "module"), ["scope", "module"], "left_anti"))
        reached = reached.unionByName(front)
    found = reached.join(public.where("kind = 'item'"), ["scope", "module"]).withColumn("path", F.array_append("path", F.col("name")))
    return found.groupBy("scope", F.col("target").alias("module"), "item").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("best")).select("scope", "module", "item", F.array_join("best.path", "::").alias("path"))
