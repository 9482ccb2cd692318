"""From a library's API surface to its symbol chunks, and an index of the anchors that prose may cite it by."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from lodestrata.functions import predicates, rendering
from lodestrata.sources import schemas

from . import claims, graph, selection
from .staging import cut

#: What is cited and is no symbol: target frameworks, versions, files, package ids of a product line.
FRAMEWORK = r"\A(?:net[0-9]+(?:\.[0-9]+)?(?:-[a-z]+)?|netstandard[0-9]+(?:\.[0-9]+)?|netcoreapp[0-9]+(?:\.[0-9]+)?)\z"
VERSION = r"\Av?[0-9]+(?:\.[0-9]+)+"
FILE = r"\.(?:cs|csproj|props|sln|py|toml|cfg|txt|md|json|yaml|yml|xml|go|mod|sum|rs|java|gradle|ts|js|mjs|cjs|h|hpp|cpp|cmake|lock|ini|dll)\z"
PRODUCT_LINE = "FOSS"

FIRST_TYPES = 300


@functools.cache
def _fields(kind: str) -> dict[str, DataType]:
    return {f.name: f.dataType for f in DataType.fromDDL(kind).fields}


def _filled(e: Column, name: str) -> Column:
    return F.coalesce(e[name], F.lit("")) != ""


def _as(rows: DataFrame, name: str, kind: DataType) -> Column:
    """A column as a kind: null where it is not there; fields that a nested one lacks are null."""
    if name not in rows.columns:
        return F.lit(None).cast(kind)
    if rows.schema[name].dataType == kind or kind.typeName() not in ("array", "struct"):
        return F.col(name).cast(kind)
    return F.from_json(F.to_json(F.struct(F.col(name).alias("x"))), StructType().add("x", kind))["x"]


def _as_method(e: Column) -> Column:
    """An entry as a method of its own name, for functions, which list none."""
    own = [e[f].alias(f) if f in _fields(schemas.TYPE) else F.lit(None).alias(f) for f in _fields(schemas.METHOD)]
    return F.struct(*own).cast(schemas.METHOD)


def pairs(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """shell, definition (ids) of entries (id, e) of each scope: what an entry says that it re-exports, the first one at that path;
    then stubs that stand for the only definition (`graph.stub_pairs`). A chain is followed to its end; one that runs in a
    circle is none."""
    # names of different scopes are different names
    scoped = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in by), F.col("e.name"))
    held = entries.select(
        "id", scoped.alias("name"), F.col("e.kind").alias("kind"), F.col("e.class_import").alias("import_path"), F.coalesce("e.file", F.lit("")).alias("file"), rendering.n_members(F.col("e")).alias("members"),
        F.lit(False).alias("is_test"), _filled(F.col("e"), "shadows").alias("shadows"), _filled(F.col("e"), "shadowed_by").alias("shadowed"),
    )
    at = entries.where(_filled(F.col("e"), "class_import")).groupBy(*by, F.col("e.class_import").alias("path")).agg(F.min("id").alias("definition"))
    said = entries.where(_filled(F.col("e"), "reexport_of")).select(*by, F.col("id").alias("shell"), F.col("e.reexport_of").alias("path"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}")) for c in by]
    explicit = said.alias("s").join(at.alias("a"), [*same, F.col("s.path") == F.col("a.path")]).where("shell <> definition").select("shell", "definition")
    explicit = graph.chain_ends(explicit.select(F.col("shell").alias("node"), F.col("definition").alias("next"))).select(F.col("node").alias("shell"), F.col("end").alias("definition"))
    every = explicit.unionByName(graph.stub_pairs(held, explicit).select("shell", "definition"))
    return graph.chain_ends(every.select(F.col("shell").alias("node"), F.col("definition").alias("next"))).select(F.col("node").alias("shell"), F.col("end").alias("definition"))


def _named(kept: DataFrame, by: Sequence[str]) -> DataFrame:
    """kept with fqn: the import path or name; those that several have are qualified by receiver, namespace or file; where that
    is not enough the line is put behind; where that is not enough a number."""
    own = F.when(_filled(F.col("e"), "class_import"), F.col("e.class_import")).otherwise(F.coalesce("e.name", F.lit("")))
    base = F.element_at(F.split(F.replace(F.coalesce("e.file", F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    space = F.col("e.canonical_namespace")
    qualifier = F.when(_filled(F.col("e"), "receiver_type"), F.col("e.receiver_type")).when(_filled(F.col("e"), "canonical_namespace") & ~F.startswith("fqn", space), space).otherwise(F.regexp_replace(base, r"\.[^.]*\z", ""))
    many = lambda c: F.count("*").over(Window.partitionBy(*by, c)) > 1
    step = kept.withColumn("fqn", own).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("ord")) - 1)
    step = step.withColumn("fqn", F.when(many("fqn"), F.concat(qualifier, F.lit("."), F.coalesce(F.nullif(F.col("e.name"), F.lit("")), F.col("fqn")))).otherwise(F.col("fqn")))
    step = step.withColumn("fqn", F.when(many("fqn"), F.concat("fqn", F.lit("@"), F.coalesce("e.line", "place").cast("string"))).otherwise(F.col("fqn")))
    nth = F.row_number().over(Window.partitionBy(*by, "fqn").orderBy("ord"))
    return step.withColumn("fqn", F.when(nth > 1, F.concat("fqn", F.lit("#"), nth.cast("string"))).otherwise(F.col("fqn"))).drop("place")


def symbol_chunks(surface: DataFrame, by: Sequence[str] = ("source_repository", "source_commit"), most: int = FIRST_TYPES) -> DataFrame:
    """by, ord, fqn, section_title, text, definition (its fqn; null for a definition) of a surface's entries (by, ord and the fields
    of schemas.TYPE; fields that it lacks are null).

    Entries of test sources are left out. A definition and what re-exports it are one slot, which stands where its first
    entry does; the first `most` slots of each scope are kept, whole. What re-exports another points to it, and lists no
    members. Every chunk says what share of the scope's types, constants and functions is kept. Entries come once for each (by, ord);
    nulls in `by` are a scope."""
    entries = surface.select(*by, "ord", F.struct(*(_as(surface, c, t).alias(c) for c, t in _fields(schemas.TYPE).items())).alias("e"))
    entries = entries.where(~F.coalesce(predicates.test_source("e.file"), F.lit(False)))
    entries = cut(entries.withColumn("id", F.struct(*by, "ord")))
    paired = cut(pairs(entries, by))
    slot = paired.groupBy(F.col("definition").alias("id")).agg(F.min("shell").alias("first")).select("id", F.least("id", "first").alias("unit"))
    with_unit = entries.join(paired.withColumnRenamed("shell", "id"), "id", "left").withColumn("head", F.coalesce("definition", "id")).join(slot.withColumnRenamed("id", "head"), "head", "left").withColumn("unit", F.coalesce("unit", "id"))
    first = with_unit.where("unit = id").withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("ord"))).where(F.col("n") <= most).select("unit")
    marked = cut(with_unit.join(first.withColumn("kept", F.lit(True)), "unit", "left").withColumn("kept", F.coalesce("kept", F.lit(False))))
    covered = selection.coverage_line(marked.select(*by, F.col("e.kind").alias("kind"), "kept", F.col("definition").isNull().alias("definition")), list(by))
    named = cut(_named(marked.where("kept").drop("unit", "head", "kept"), by))
    to = named.select(F.col("id").alias("definition"), F.col("fqn").alias("defined_in"))
    pointed = named.select("id", "definition", "ord", "fqn").where("definition IS NOT NULL")
    shown = pointed.groupBy(F.col("definition").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "fqn"))), lambda x: x["fqn"]).alias("exported_as"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by]
    whole = named.join(to, "definition", "left").join(shown, "id", "left").alias("n").join(covered.alias("c"), same, "left").select("n.*", "c.coverage")
    text = rendering.symbol(F.col("e"), F.col("fqn"), _as_method, F.col("defined_in"), F.coalesce("exported_as", F.array().cast("array<string>")), F.nullif(F.col("coverage"), F.lit("")))
    return whole.select(*by, "ord", "fqn", F.concat("fqn", rendering.deprecated(F.col("e"))).alias("section_title"), text.alias("text"), F.col("defined_in").alias("definition"))


def anchor_forms(surface: DataFrame, by: Sequence[str] = ("source_repository", "source_commit")) -> DataFrame:
    """by, anchor, last, entry: the ways to cite each type and its methods, properties and members: by its name, its import path, and
    its namespace and name; once an entry. Namespaces and what stands before them are anchors of no entry. last: the last segment."""
    none = F.array().cast("array<string>")
    blank = lambda c: F.nullif(F.col(c), F.lit("")) if c in surface.columns else F.lit(None).cast("string")
    names = lambda c: F.coalesce(F.transform(F.col(c), lambda m: m["name"]), none) if c in surface.columns else none
    space = F.coalesce(blank("canonical_namespace"), blank("class_package"))
    prefixes = F.array_distinct(F.array_compact(F.array(blank("name"), blank("class_import"), F.concat(space, F.lit("."), blank("name")))))
    members = F.array_distinct(F.filter(F.concat(names("methods"), names("properties"), names("enum_members")), lambda m: F.coalesce(m, F.lit("")) != ""))
    cited = F.flatten(F.transform("prefixes", lambda p: F.concat(F.array(p), F.transform("members", lambda m: F.concat(p, F.lit("."), m)))))
    held = surface.where(blank("name").isNotNull()).select(*by, F.col("ord").alias("entry"), prefixes.alias("prefixes"), members.alias("members"))
    typed = held.select(*by, "entry", F.explode(F.array_distinct(cited)).alias("anchor"))
    spaces = surface.select(*by, F.explode(F.array_compact(F.array(blank("canonical_namespace"), blank("class_package")))).alias("space")).distinct()
    parts = F.split("space", r"\.")
    above = spaces.select(*by, F.lit(None).cast(surface.schema["ord"].dataType).alias("entry"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("anchor")).distinct()
    return typed.unionByName(above).select(*by, "anchor", F.substring_index("anchor", ".", -1).alias("last"), "entry")


@dataclass
class AnchorIndex:
    """Anchors by their last segment, as Parquet: partitioned by its hash and sorted by it. The segments of a stated set of
    anchors, up to MOST_ASKED of them, become filters: only their partitions and row groups are read; more are joined. Joins say
    `merge`: what is exploded is planned by the size of the narrow table under it, and would be broadcast."""

    by: list[str]
    forms: DataFrame
    buckets: int

    MOST_ASKED = 4096

    @classmethod
    def build(cls, forms: DataFrame, folder: str, by: Sequence[str] = ("source_repository", "source_commit"), buckets: int = 32) -> AnchorIndex:
        """forms: as `anchor_forms` gives them. One shuffle; a name that very many types share is dealt over the files of its bucket."""
        bucket = F.pmod(F.xxhash64("last"), F.lit(buckets)).cast("int")
        dealt = forms.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("anchor"), F.lit(4))).sortWithinPartitions("bucket", "last")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        return cls.open(forms, folder, by, buckets)

    @classmethod
    def open(cls, forms: DataFrame, folder: str, by: Sequence[str], buckets: int) -> AnchorIndex:
        kinds = {f.name: f.dataType.simpleString() for f in forms.schema}
        schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "anchor", "last", "entry")) + ", bucket int"
        return cls(list(by), forms.sparkSession.read.schema(schema).parquet(folder), buckets)

    def of_last(self, asked: DataFrame) -> DataFrame:
        """The forms whose last segment is in asked (last)."""
        lasts = asked.select("last").distinct()
        rows: list[Row] = lasts.select("last", F.pmod(F.xxhash64("last"), F.lit(self.buckets)).cast("int").alias("bucket")).limit(self.MOST_ASKED + 1).collect()  # bounded
        if len(rows) > self.MOST_ASKED:
            return self.forms.join(lasts.hint("merge"), "last", "left_semi")
        return self.forms.where(F.col("bucket").isin(sorted({r.bucket for r in rows})) & F.col("last").isin(sorted(r.last for r in rows)))

    def classified(self, cited: DataFrame) -> DataFrame:
        """by, anchor, n, class of what is cited (by, anchor), each once: symbol, where the index has it or, for a bare name, just one
        anchor ends in it; non_symbol for versions, frameworks, files and package ids; else unresolved. n: how many declare it."""
        asked = cited.select(*self.by, "anchor").where("anchor IS NOT NULL").distinct().withColumn("last", F.substring_index("anchor", ".", -1))
        found = self.of_last(asked)
        exact = found.groupBy(*self.by, "anchor").agg(F.count("entry").alias("n"), F.lit(True).alias("known"))
        ends = found.where(F.col("entry").isNotNull() & (F.col("anchor") != F.col("last"))).groupBy(*self.by, "last").agg(F.countDistinct("anchor").alias("ends"))
        same = lambda a, b, key: [*(F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in self.by), F.col(f"{a}.{key}") == F.col(f"{b}.{key}")]
        joined = asked.alias("a").join(exact.hint("merge").alias("x"), same("a", "x", "anchor"), "left").join(ends.hint("merge").alias("e"), same("a", "e", "last"), "left")
        joined = joined.select("a.*", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("ends", F.lit(0)).alias("ends"))
        bare = ~F.col("anchor").contains(".") & (F.col("ends") == 1)
        other = F.regexp_like("anchor", F.lit(FRAMEWORK)) | F.regexp_like("anchor", F.lit(VERSION)) | F.regexp_like("anchor", F.lit(FILE)) | (F.upper("last") == PRODUCT_LINE)
        return joined.select(*self.by, "anchor", "n", F.when(F.col("known") | bare, "symbol").when(other, "non_symbol").otherwise("unresolved").alias("class"))

    def neutralised(self, prose: DataFrame, key: str, text: str = "text") -> DataFrame:
        """prose (by, key, text) with the text in which code spans that cite nothing that is there have lost their backticks, and
        neutralised, their number. key names a row. A null text stays null."""
        cited = prose.select(*self.by, key, F.explode(F.array_distinct(claims.anchors(F.coalesce(F.col(text), F.lit(""))))).alias("anchor"))
        gone = self.classified(cited).where(F.col("class") == "unresolved")
        same = [*(F.col(f"p.{c}").eqNullSafe(F.col(f"g.{c}")) for c in self.by), F.col("p.anchor") == F.col("g.anchor")]
        wrong = cited.alias("p").join(gone.hint("merge").alias("g"), same).groupBy(F.col(f"p.{key}").alias("_key")).agg(F.collect_set("p.anchor").alias("_gone"))  # of one text
        held = prose.join(wrong.hint("merge"), F.col(key).eqNullSafe(F.col("_key")), "left")
        made = held.withColumn("_made", claims.unmarked(F.col(text), F.coalesce("_gone", F.array().cast("array<string>"))))
        return made.withColumn(text, F.col("_made.text")).withColumn("neutralised", F.coalesce("_made.n", F.lit(0))).drop("_made", "_key", "_gone")
