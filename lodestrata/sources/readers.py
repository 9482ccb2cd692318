"""Readers of the published and staged files. All of them go through Spark's file readers."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def chunk_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of `{"chunks": [...]}` files, with their place in the file."""
    return spark.read.schema(schemas.CHUNK_FILE).option("multiLine", True).json(path).select(F.posexplode("chunks").alias("ord", "c")).select("ord", "c.*")


def api_surface(spark: SparkSession, path: str) -> DataFrame:
    """A row for each type, with the artifact's repository and commit."""
    return spark.read.schema(schemas.API_SURFACE).option("multiLine", True).json(path).select("source_repository", "source_commit", "language", F.posexplode("types").alias("ord", "t")).select("source_repository", "source_commit", "language", "ord", "t.*")


def releases(spark: SparkSession, path: str) -> DataFrame:
    """A release sidecar's rows in order; a file that is not there is an error of its own, not an empty list."""
    return spark.read.schema(schemas.RELEASE).option("multiLine", True).json(path)


def publish_log(spark: SparkSession, path: str) -> DataFrame:
    """Log lines, oldest first; malformed lines are skipped."""
    lines = spark.read.schema(schemas.PUBLISH_LOG + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    return lines.where("_bad is null and ts is not null").drop("_bad").orderBy("ts")


def verification_cache(spark: SparkSession, path: str) -> DataFrame:
    cache = spark.read.schema(f"schema_version int, entries array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in schemas.VERDICT.split(','))}>>").option("multiLine", True).json(path)
    return cache.where("schema_version = 1").select(F.explode("entries").alias("e")).select("e.*")


def embedding_caches(spark: SparkSession, path: str) -> DataFrame:
    """file_ord, text_sha, vector of all cache files; the order is that of their names."""
    files = spark.read.schema(schemas.EMBEDDING_CACHE).option("multiLine", True).json(path).select(F.col("_metadata.file_name").alias("file_ord"), F.explode("entries").alias("text_sha", "vector"))
    return files


def whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def source_files(spark: SparkSession, path: str, glob: str, excluded: str = r"/(?:tests?|examples?|\.git|node_modules|build|dist)/") -> DataFrame:
    """Source files under a folder, without test and build folders."""
    return whole_texts(spark, path, glob).where(~F.regexp_like("path", F.lit(excluded)))


def front_matter(text: Column | str) -> Column:
    """A struct (meta, body): what stands between the first two `---` lines, and the rest."""
    t = F.col(text) if isinstance(text, str) else text
    pattern = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n(.*))?\z"
    return F.when(F.regexp_like(t, F.lit(pattern)), F.struct(F.regexp_extract(t, pattern, 1).alias("meta"), F.regexp_extract(t, pattern, 2).alias("body"))).otherwise(F.struct(F.lit(None).cast("string").alias("meta"), t.alias("body")))


def simple_yaml(meta: Column | str) -> Column:
    """The top-level `key: value` lines as a map."""
    m = F.col(meta) if isinstance(meta, str) else meta
    key, value = (F.regexp_extract_all(m, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]+(\S.*?)[ \t]*$"), F.lit(k)) for k in (1, 2))
    return F.map_from_arrays(F.array_distinct(key), F.transform(F.array_distinct(key), lambda k: F.regexp_replace(F.get(value, (F.array_position(key, k) - 1).cast("int")), r"""^["']|["']$""", "")))


MANIFEST_FIELDS = ("name", "version", "license", "requires")


def parse_manifest(kind: str, text: str) -> dict[str, str]:
    """The identity fields of a packaging manifest as it states them; what cannot be read is empty."""
    out = dict.fromkeys(MANIFEST_FIELDS, "")
    find = lambda pattern: (m[1].strip() if (m := re.search(pattern, text or "")) else "")
    if kind in ("python", "rust"):
        try:
            held = tomllib.loads(text)
        except (tomllib.TOMLDecodeError, TypeError):
            return out
        own = held.get("project" if kind == "python" else "package", {})
        licence = own.get("license", "")
        return {"name": str(own.get("name", "")), "version": str(own.get("version", "")), "license": str(licence.get("text", "") if isinstance(licence, dict) else licence), "requires": str(own.get("requires-python", own.get("rust-version", "")))}
    patterns = {
        "dotnet": (r"<PackageId>([^<]*)<", r"<Version>([^<]*)<", r"<PackageLicenseExpression>([^<]*)<", r"<TargetFrameworks?>([^<]*)<"),
        "java": (r"<artifactId>([^<]*)<", r"<version>([^<]*)<", r"(?s)<license>.*?<name>([^<]*)<", r"<maven\.compiler\.(?:source|release)>([^<]*)<"),
        "js": (r'"name"\s*:\s*"([^"]*)"', r'"version"\s*:\s*"([^"]*)"', r'"license"\s*:\s*"([^"]*)"', r'"node"\s*:\s*"([^"]*)"'),
        "go": (r"(?m)^module\s+(\S+)", r"(?!)", r"(?!)", r"(?m)^go\s+(\S+)"),
        "cpp": (r"(?i)project\s*\(\s*(\w+)", r"(?i)project\s*\([^)]*\bVERSION\s+([\d.]+)", r"(?!)", r"(?i)CMAKE_CXX_STANDARD\s+(\d+)"),
    }
    return dict(zip(MANIFEST_FIELDS, map(find, patterns[kind]), strict=True)) if kind in patterns else out


def manifests(files: DataFrame, kind: str = "kind", text: str = "text") -> DataFrame:
    """files with a struct manifest of MANIFEST_FIELDS, by each row's kind."""

    @F.pandas_udf("name string, version string, license string, requires string")
    def parsed(kinds: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_manifest(k, t) for k, t in zip(kinds, texts, strict=True)], columns=list(MANIFEST_FIELDS))

    return files.withColumn("manifest", parsed(kind, text))


def python_surface(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, name, kind, owner, line, doc, stub of the public classes, functions and methods of Python sources, parsed and
    never imported. A file that does not parse gives one row of kind parse_error."""
    from lodestrata.operators.surface import python_symbols

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *s) for p, t in zip(batch[path], batch[text], strict=True) for s in python_symbols(t or "")]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "owner", "line", "doc", "stub", "deprecated"])

    return files.select(path, text).mapInPandas(run, "path string, name string, kind string, owner string, line int, doc string, stub boolean, deprecated boolean")


def release_state(found: bool, failed: bool) -> str:
    """Three states of a sidecar; absent is not empty."""
    return "fetch_failed" if failed else "present" if found else "not_present"
