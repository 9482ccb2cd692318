"""Packaging manifests of repositories: which one states a library's identity, which one a source file belongs to, and the oldest
runtime that it asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The manifests of each platform by file name, in order of preference, and how deep they may lie (None: anywhere);
#: where a Java build states its runtime, in order; the rank of a target framework that none of the rules names.
NAMES = (
    ("python", "pyproject.toml", 0),
    ("python", "setup.py", 0),
    ("dotnet", "*.csproj", None),
    ("java", "pom.xml", 0),
    ("java", "build.gradle", 0),
    ("js", "package.json", 0),
    ("cpp", "CMakeLists.txt", 0),
    ("go", "go.mod", 0),
    ("rust", "Cargo.toml", 1),
)
JAVA_RUNTIME = (
    r"<maven\.compiler\.release>(.*?)</maven\.compiler\.release>",
    r"<maven\.compiler\.target>(.*?)</maven\.compiler\.target>",
    r"<maven\.compiler\.source>(.*?)</maven\.compiler\.source>",
    r"""targetCompatibility\s*=\s*['"]?(\d+)""",
    r"""sourceCompatibility\s*=\s*['"]?(\d+)""",
    r"languageVersion\.of\((\d+)\)",
)
UNKNOWN = 100


def clean(path: Column | str) -> Column:
    """A path with slashes, without one at its start."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), r"\A(?:\./|/)+", "")


def folders(path: Column) -> Column:
    """Structs (depth, folder) of the folders that hold a path: the root, which is empty, first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder")))


def found(files: DataFrame, by: str = "repository", path: str = "path") -> DataFrame:
    """files that are manifests, with platform, rank (in the platform's order), depth and folder; the path is cleaned."""
    at = files.withColumn(path, clean(path))
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\A.+\.csproj\z", "*.csproj")
    own = at.withColumn("rank", F.array_position(F.lit([n for _, n, _ in NAMES]), name).cast("int")).where("rank > 0")  # from 1
    platform, depth = F.element_at(F.lit([p for p, _, _ in NAMES]), F.col("rank")), F.size(F.split(path, "/")) - 1
    return own.select(*files.columns, platform.alias("platform"), "rank", depth.alias("depth"), F.regexp_replace(F.col(path), r"/?[^/]*\z", "").alias("folder"))


def of_repository(files: DataFrame, by: str = "repository", path: str = "path") -> DataFrame:
    """by, platform, path: the manifest that states a repository's identity, for each platform that it has: the one preferred by
    name, of several the one nearest to the root, then the first by path. Most must lie in the root itself. A struct's
    minimum is worked out before the shuffle, whatever the number of files."""
    deepest = F.element_at(F.lit([-1 if most is None else most for *_, most in NAMES]), F.col("rank"))
    near = (deepest < 0) | (F.col("depth") <= deepest)
    best = F.min(F.struct("rank", "depth", path))
    return found(files.select(by, path), by, path).where(near).groupBy(by, "platform").agg(best.alias("best")).select(by, "platform", F.col(f"best.{path}").alias(path))


def of_sources(sources: DataFrame, files: DataFrame, by: str = "repository", path: str = "path", platform: str | None = None) -> DataFrame:
    """sources (by, path) with manifest: the one in the nearest folder above, of several there the preferred, then the first by
    path; null where there is none. The folders above each source are exploded and joined by equality."""
    held = found(files.select(by, path), by, path)
    held = held.where(F.col("platform") == platform) if platform else held
    one = held.groupBy(by, "folder").agg(F.min(F.struct("rank", path))[path].alias("manifest"))
    above = sources.select(by, path).distinct().select(by, path, F.explode(folders(clean(path))).alias("x")).select(by, path, "x.*")
    best = above.join(one, [by, "folder"]).groupBy(by, path).agg(F.max_by("manifest", "depth").alias("manifest"))
    same = F.col(f"s.{by}").eqNullSafe(F.col(f"b.{by}")) & (F.col(f"s.{path}") == F.col(f"b.{path}"))
    return sources.alias("s").join(best.alias("b"), same, "left").select("s.*", "b.manifest")


def framework_rank(target: Column) -> Column:
    """How widely a target framework runs, the widest first: the standard by its version, then platforms from 5 to 9."""
    standard = F.regexp_extract(target, r"\Anetstandard(1\.[0-6]|2\.[01])\z", 1)
    platform = F.regexp_extract(target, r"\Anet([5-9])\.0\z", 1)
    return F.when(standard != "", F.round(F.try_multiply(standard.try_cast("double"), F.lit(10))).cast("int")).when(platform != "", platform.try_cast("int") * 10).otherwise(UNKNOWN)


def frameworks(text: Column | str) -> Column:
    """A struct (targets, first, lowest) of a .NET project; of equally wide ones the first. Null where it states none."""
    t = F.col(text) if isinstance(text, str) else text
    many, one = (rf"<TargetFramework{s}>(.*?)</TargetFramework{s}>" for s in ("s", ""))
    said = F.when(F.regexp_like(t, F.lit(many)), F.split(F.regexp_extract(t, many, 1), ";")).when(F.regexp_like(t, F.lit(one)), F.array(F.regexp_extract(t, one, 1)))
    targets = F.filter(F.transform(said, lambda x: F.btrim(x)), lambda x: x != "")
    ranked = F.array_min(F.transform(targets, lambda x, n: F.struct(framework_rank(x).alias("rank"), n.alias("n"), x.alias("x"))))
    return F.when(targets.isNotNull(), F.struct(targets.alias("targets"), F.coalesce(F.get(targets, F.lit(0)), F.lit("")).alias("first"), F.coalesce(ranked["x"], F.lit("")).alias("lowest")))


def java_runtime(text: Column | str) -> Column:
    """The Java version that a build asks for; null where it says nothing."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(*(F.nullif(F.btrim(F.regexp_extract(t, p, 1)), F.lit("")) for p in JAVA_RUNTIME))
