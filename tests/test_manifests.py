"""Manifests of repositories against plain rules over small trees."""

from __future__ import annotations

from lodestrata.operators import manifests

TREE = ["pyproject.toml", "setup.py", "a/pyproject.toml", "z.csproj", "./src/a.csproj", "src\\deep\\b.csproj", "x/Cargo.toml", "b/Cargo.toml", "a/b/Cargo.toml", "sub/pom.xml", "build.gradle", "README.md", "my.csproj.bak"]


def rows(spark, paths, repository="r"):
    return spark.createDataFrame([(repository, p) for p in paths], "repository string, path string")


def test_the_manifest_of_a_repository(spark):
    found = {r.platform: r.path for r in manifests.of_repository(rows(spark, TREE)).collect()}
    assert found == {"python": "pyproject.toml", "dotnet": "z.csproj", "rust": "b/Cargo.toml", "java": "build.gradle"}
    deep = {r.platform: r.path for r in manifests.of_repository(rows(spark, TREE[4:])).collect()}
    assert deep["dotnet"] == "src/a.csproj" and "python" not in deep
    assert manifests.of_repository(rows(spark, [])).count() == 0


def test_the_manifest_of_a_source_is_the_nearest_above(spark):
    sources = ["src/deep/er/x.cs", "src/y.cs", "srcs/y.cs", "x.cs", "a/b/c.rs", "x/y/z.rs"]
    found = {r.path: r.manifest for r in manifests.of_sources(rows(spark, sources), rows(spark, TREE)).collect()}
    assert found == {"src/deep/er/x.cs": "src/deep/b.csproj", "src/y.cs": "src/a.csproj", "srcs/y.cs": "pyproject.toml", "x.cs": "pyproject.toml", "a/b/c.rs": "a/b/Cargo.toml", "x/y/z.rs": "x/Cargo.toml"}
    net = {r.path: r.manifest for r in manifests.of_sources(rows(spark, sources), rows(spark, TREE), platform="dotnet").collect()}
    assert net["srcs/y.cs"] == "z.csproj" and net["a/b/c.rs"] == "z.csproj"
    other = manifests.of_sources(rows(spark, ["x.cs", None]).unionByName(rows(spark, ["x.cs"], None)), rows(spark, TREE, "q"))
    assert [r.manifest for r in other.collect()] == [None] * 3


def test_frameworks_and_runtimes(spark):
    cases = [
        ("<TargetFrameworks> net8.0; netstandard2.0 ;net48;</TargetFrameworks><TargetFramework>net5.0</TargetFramework>", (["net8.0", "netstandard2.0", "net48"], "net8.0", "netstandard2.0"), None),
        ("<TargetFramework>net9.0</TargetFramework>", (["net9.0"], "net9.0", "net9.0"), None),
        ("<TargetFrameworks>net48;net472</TargetFrameworks>", (["net48", "net472"], "net48", "net48"), None),
        ("<TargetFrameworks>;</TargetFrameworks>", ([], "", ""), None),
        ("<maven.compiler.source>8</maven.compiler.source><maven.compiler.release> 17 </maven.compiler.release>", None, "17"),
        ("sourceCompatibility = '11'\nlanguageVersion.of(21)", None, "11"),
        ("languageVersion.of(21)", None, "21"),
        (None, None, None),
    ]
    held = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string").select("i", manifests.frameworks("text").alias("f"), manifests.java_runtime("text").alias("j"))
    for r in held.collect():
        assert (tuple(r.f) if r.f else None, r.j) == cases[r.i][1:]
