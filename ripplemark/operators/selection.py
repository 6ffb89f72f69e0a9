"""Selecting and grouping tests: config dependencies, runners, project roots.

Groups are kept as rows, one per member: a test with very many settings or
a runner with very many tests never becomes one oversized array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions import paths as P

# ---- fixed values: runner names, project markers, language markers ----
RUNNER_OF_EXTENSION = {
    "py": "pytest",
    "js": "npm (jest/mocha)", "jsx": "npm", "ts": "npm", "tsx": "npm", "mjs": "npm", "cjs": "npm",
    "java": "maven", "kt": "maven",
    "go": "go test", "rb": "rspec", "php": "phpunit", "rs": "cargo test",
    "c": "ctest", "cs": "dotnet test", "cpp": "ctest",
}
EXTENSION_GROUPS = {"js": "js", "ts": "js", "py": "py", "cs": "cs", "java": "java"}
PROJECT_MARKERS = {
    "js": ["package.json"],
    "ts": ["package.json", "tsconfig.json"],
    "py": ["pyproject.toml", "setup.py", "pytest.ini", "requirements.txt"],
    "java": ["pom.xml", "build.gradle", "build.gradle.kts"],
    "cs": ["*.csproj", "*.sln"],
}
ROOT_SEARCH_LEVELS = 6
LANGUAGE_MARKERS = {
    "package.json": "JavaScript / Node.js",
    "tsconfig.json": "TypeScript",
    "pom.xml": "Java (Maven)",
    "build.gradle": "Java (Gradle)",
    "build.gradle.kts": "Kotlin (Gradle)",
    "go.mod": "Go",
    "Cargo.toml": "Rust",
    "Gemfile": "Ruby",
    "composer.json": "PHP",
    "requirements.txt": "Python (pip)",
    "pyproject.toml": "Python (modern)",
    "setup.py": "Python (legacy)",
    "Pipfile": "Python (pipenv)",
    "pubspec.yaml": "Dart / Flutter",
    "mix.exs": "Elixir",
    "*.csproj": "C# (.NET)",
    "*.sln": "C# / .NET Solution",
}
# ---- end of fixed values ----


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


# ------------------------------------------------- config dependencies --


def dependency_edges(access: DataFrame) -> DataFrame:
    """Distinct ``(test_id, config_key)``; repeats collapse before the shuffle."""
    return access.select("test_id", "config_key").distinct()


def dependency_sizes(edges: DataFrame) -> DataFrame:
    """Settings per test."""
    return edges.groupBy("test_id").agg(F.count("*").alias("n_keys"))


def dependency_totals(edges: DataFrame) -> DataFrame:
    """Number of tests and of edges, from the per-test counts."""
    return dependency_sizes(edges).agg(
        F.count("*").alias("n_tests"), F.coalesce(F.sum("n_keys"), F.lit(0)).alias("n_dependencies")
    )


def dependencies_of(edges: DataFrame, tests: DataFrame) -> DataFrame:
    """Settings of the asked tests; one row with NULL for an unseen test."""
    asked = tests.select("test_id").distinct()
    unseen = asked.join(dependency_sizes(edges).select("test_id"), "test_id", "left_anti")
    return edges.join(asked, "test_id", "left_semi").unionByName(
        unseen.withColumn("config_key", F.lit(None).cast("string"))
    )


def select_by_config(edges: DataFrame, changed_keys: DataFrame) -> DataFrame:
    """Tests reading a changed setting, with the settings: ``(test, setting)``.

    Edges are distinct already. Shuffled by setting, a setting most tests
    read is a skewed partition that adaptive execution splits; few changed
    settings are broadcast on their measured size instead.
    """
    changed = changed_keys.select("config_key").distinct()
    return edges.join(changed, "config_key", "left_semi").select(
        F.col("test_id").alias("test"), F.col("config_key").alias("setting")
    )


# ------------------------------------------------------------ grouping --


def group_by_runner(tests: DataFrame, runners: dict[str, str] | None = None) -> DataFrame:
    """``(runner, path)``; unknown extensions are named as such."""
    ext = P.extension("path")
    known = _lookup(RUNNER_OF_EXTENSION if runners is None else runners, ext)
    return tests.select(F.coalesce(known, F.concat(F.lit("unknown ("), ext, F.lit(")"))).alias("runner"), "path")


def group_by_extension(tests: DataFrame) -> DataFrame:
    """``(group_name, path)`` for the four run groups; others are left out."""
    return tests.select(_lookup(EXTENSION_GROUPS, P.extension("path")).alias("group_name"), "path").filter(
        F.col("group_name").isNotNull()
    )


def group_sizes(groups: DataFrame, key: str) -> DataFrame:
    return groups.groupBy(key).agg(F.count("*").alias("n_tests"))


def _markers_served(name: Column, table: dict[str, list[str]]) -> Column:
    """Extensions a marker file is a project root for."""
    served = []
    for ext, names in table.items():
        plain = [m for m in names if "*" not in m]
        test = name.isin(plain) if plain else F.lit(False)
        for wild in (m for m in names if "*" in m):
            test = test | name.endswith(wild[1:])
        served.append(F.when(test, ext))
    return F.array_compact(F.array(*served))


def project_roots(
    tests: DataFrame, files: DataFrame, markers: dict[str, list[str]] | None = None
) -> DataFrame:
    """Nearest directory with a marker for the test's extension: ``(path, root)``.

    Solved per distinct (directory, extension): six ancestors each, joined
    by equality with marker directories. Without a hit, the own directory.
    """
    served = _markers_served(P.file_name("path"), PROJECT_MARKERS if markers is None else markers)
    marked = files.select(P.directory("path").alias("root"), F.explode(served).alias("ext")).distinct()
    placed = tests.select("path", P.directory("path").alias("dir"), P.extension("path").alias("ext"))

    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    levels = F.sequence(F.lit(0), F.least(F.size(parts), F.lit(ROOT_SEARCH_LEVELS - 1)))
    ancestors = placed.select("dir", "ext").distinct().select(
        "dir", "ext", F.posexplode(F.transform(levels, lambda i: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - i), "/")))
    ).withColumnsRenamed({"pos": "steps", "col": "root"})
    nearest = (
        ancestors.join(marked, ["root", "ext"])
        .groupBy("dir", "ext")
        .agg(F.min_by("root", "steps").alias("root"))
    )
    return placed.join(nearest, ["dir", "ext"], "left").select(
        "path", F.coalesce("root", "dir").alias("root")
    )


def group_by_root(rooted: DataFrame) -> DataFrame:
    """``(root, relative_path)`` of each test."""
    inside = F.when(F.col("root") == "", F.col("path")).otherwise(
        F.substr("path", F.length("root") + 2)
    )
    return rooted.select("root", inside.alias("relative_path"))


def detect_languages(files: DataFrame, markers: dict[str, str] | None = None) -> DataFrame:
    """Languages per directory by its marker files, in marker order.

    The list has at most one entry per marker, so collecting it is bounded
    by the marker table.
    """
    table = LANGUAGE_MARKERS if markers is None else markers
    name = P.file_name("path")
    wild = F.concat(F.lit("*."), F.regexp_extract(name, "\\.([^.]+)$", 1))
    marker = F.when(name.isin([m for m in table if "*" not in m]), name).when(
        wild.isin([m for m in table if "*" in m]), wild
    )
    order = {m: str(i) for i, m in enumerate(table)}
    ranked = F.struct(
        _lookup(order, F.col("marker")).cast("int").alias("place"),
        _lookup(table, F.col("marker")).alias("language"),
    )
    return (
        files.select(P.directory("path").alias("root"), marker.alias("marker"))
        .filter(F.col("marker").isNotNull())
        .groupBy("root")
        .agg(F.array_sort(F.collect_set(ranked)).alias("found"))
        .select("root", F.col("found.language").alias("languages"))
    )


def run_summary(changes: DataFrame, tests: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row of counts over a run."""
    by_category = changes.agg(
        F.count("*").alias("changed_files"),
        F.count_if(F.col("category") == "source").alias("source_files"),
        F.count_if(F.col("category") == "config").alias("config_files"),
    )
    n_tests = tests.agg(F.count("*")).scalar()
    n_ranked = ranked.agg(F.count("*")).scalar()
    return by_category.withColumn("total_tests_analyzed", n_tests).withColumn("affected_tests_count", n_ranked)
