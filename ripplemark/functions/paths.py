"""Path predicates and names as Column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the classification tables results must agree with ----
CONFIG_DIRS = ["config", "configs", "conf", "settings", "configuration", "env", "environments"]

CONFIG_EXTENSIONS = [
    "yaml", "yml", "toml", "ini", "cfg", "conf", "properties", "env", "hcl", "tf", "tfvars",
    "dockerfile", "xml",
]

CONFIG_NAME_MARKERS = [".config.", "config.", ".conf.", ".settings", ".env", "-config.", "_config."]

CONFIG_FILE_NAMES = [
    "dockerfile", "docker-compose.yml", "docker-compose.yaml", "jenkinsfile", "makefile", "vagrantfile",
    "package.json", "tsconfig.json", "jsconfig.json", "jest.config.js", "jest.config.ts",
    "vitest.config.js", "babel.config.js", "webpack.config.js", "vite.config.js", "rollup.config.js",
    "eslint.config.js", "prettier.config.js", ".eslintrc", ".eslintrc.json", ".eslintrc.js",
    ".prettierrc", ".prettierrc.json", ".prettierrc.js", ".babelrc", ".browserslistrc",
    "setup.py", "setup.cfg", "pyproject.toml", "tox.ini", "requirements.txt", "requirements-dev.txt",
    "pipfile", "poetry.lock", "alembic.ini", "pytest.ini", ".pylintrc", ".flake8",
    "pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle", "gradle.properties",
    "application.properties", "application.yml", "application.yaml", "logback.xml", "log4j2.xml",
    "web.config", "app.config", "appsettings.json", "appsettings.development.json",
    "appsettings.production.json", "nuget.config", "global.json",
    "go.mod", "go.sum", "cargo.toml", "cargo.lock", "gemfile", "gemfile.lock", "rakefile",
    "composer.json", "composer.lock", ".htaccess", "chart.yaml", "values.yaml", ".gitlab-ci.yml",
    ".github", ".gitignore", ".dockerignore", ".editorconfig", ".gitattributes",
]

CONFIG_NAME_STARTS = ["config", "settings", "conf."]

SOURCE_EXTENSIONS = [
    "py", "pyx", "pxd", "pyi", "js", "jsx", "mjs", "cjs", "ts", "tsx",
    "java", "kt", "kts", "scala", "groovy", "c", "h", "cpp", "cc", "cxx", "hpp", "hh", "hxx",
    "cs", "fs", "vb", "go", "rs", "rb", "erb", "php", "phtml", "swift", "m", "mm",
    "sh", "bash", "zsh", "fish", "ps1", "html", "htm", "css", "scss", "sass", "less", "vue", "svelte",
    "sql", "graphql", "gql", "ex", "exs", "erl", "hrl", "hs", "lhs", "ml", "mli", "clj", "cljs",
    "dart", "lua", "pl", "pm", "r", "jl", "nim", "zig", "v",
]

# Every accepted test-name pattern contains one of these two words.
TEST_WORDS = ["test", "spec"]

ARTIFACT_NAMES = ["analyzer_result.json", "test_dependencies.json", ".coverage", "coverage.xml", "pytest.xml"]
ARTIFACT_SUFFIXES = [".pyc", ".pyo", ".class", ".log", ".tmp"]
ARTIFACT_DIRS = ["venv", "node_modules", "__pycache__", ".pytest_cache", ".git", "dist", "build", "coverage"]

SCAN_SKIP_DIRS = [
    "node_modules", "venv", ".git", "__pycache__", "dist", "build", "coverage", ".pytest_cache",
    "target", "bin", "obj", "images", ".idea", ".vscode",
]

SERVICE_NAME_PREFIXES = ["test_", "spec_", "tests_", "itest_", "it_"]
SERVICE_NAME_SUFFIXES = [
    "_service_test", "_service_tests", "_service_spec", ".service.test", ".service.spec", ".service",
    "_service", "service", "_config", ".config", "-config", "_settings", ".settings",
    "_test", ".test", "_tests", ".tests", "_spec", ".spec", "_server", ".server", "_client", ".client",
    "_handler", ".handler", "_controller", ".controller", "_repository", ".repository",
    "_dao", ".dao", "_model", ".model", "_view", ".view",
]
GENERIC_NAMES = [
    "app", "main", "index", "server", "service", "handler", "controller", "model", "view", "__init__",
]
PLAIN_DIRS = ["src", "test", "tests", "lib", "app", "main", "java", "python", "js"]
# ---- end of fixed values ----


def _col(path: Column | str) -> Column:
    return F.col(path) if isinstance(path, str) else path


def _escape(text: str) -> str:
    return "".join("\\" + ch if ch in ".-" else ch for ch in text)


def _any_of(words: list[str], longest_first: bool = False) -> str:
    ordered = sorted(words, key=len, reverse=True) if longest_first else words
    return "(?:" + "|".join(_escape(w) for w in ordered) + ")"


# Regular expressions both engines of the checks can run.
CONFIG_MARKER_RE = _any_of(CONFIG_NAME_MARKERS)
CONFIG_START_RE = "^" + _any_of(CONFIG_NAME_STARTS)
TEST_RE = "|".join(TEST_WORDS)
ARTIFACT_SUFFIX_RE = _any_of(ARTIFACT_SUFFIXES) + "$"
NAME_PREFIX_RE = "^" + _any_of(SERVICE_NAME_PREFIXES)
# Two steps: an anchored alternation takes the leftmost, hence longest, suffix.
NAME_SUFFIX_RE = _any_of(SERVICE_NAME_SUFFIXES, longest_first=True) + "$"


def segments(path: Column | str) -> Column:
    """Non-empty parts of a path."""
    return F.filter(F.split(_col(path), "/"), lambda p: ~p.isin("", "."))


def parents(path: Column | str) -> Column:
    """The directory parts, outermost first."""
    parts = segments(path)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def directory(path: Column | str) -> Column:
    """Everything before the last slash; '' for a file at the root."""
    p = _col(path)
    return F.substring(p, F.lit(1), F.length(p) - F.length(file_name(p)) - 1)


def _suffix(path: Column | str) -> Column:
    """Text after the last dot of the name, '' when only a leading dot is there."""
    name = file_name(path)
    dotted = F.contains(F.substr(name, F.lit(2)), F.lit("."))
    return F.when(dotted, F.substring_index(name, ".", -1)).otherwise("")


def extension(path: Column | str) -> Column:
    """Last suffix in lower case without its dot; '.env' has none."""
    return F.lower(_suffix(path))


def stem(path: Column | str) -> Column:
    """File name without its last suffix."""
    name, suffix = file_name(path), _suffix(path)
    return F.when(suffix == "", name).otherwise(
        F.substring(name, F.lit(1), F.length(name) - F.length(suffix) - 1)
    )


def has_part(path: Column | str, names: list[str]) -> Column:
    """Whether a directory or the file itself has one of the names."""
    return _col(path).rlike("(?:^|/)" + _any_of(names) + "(?:/|$)")


def has_parent(path: Column | str, names: list[str]) -> Column:
    """Whether a directory has one of the names, in any case."""
    return F.lower(_col(path)).rlike("(?:^|/)" + _any_of(names) + "/")


def is_source_file(path: Column | str, extensions: list[str] | None = None) -> Column:
    return extension(path).isin(SOURCE_EXTENSIONS if extensions is None else extensions)


def is_config_file(path: Column | str) -> Column:
    name = F.lower(file_name(path))
    return (
        has_parent(path, CONFIG_DIRS)
        | name.isin(CONFIG_FILE_NAMES)
        | name.rlike(CONFIG_MARKER_RE)
        | (extension(path).isin(CONFIG_EXTENSIONS) & ~is_source_file(path))
        | name.rlike(CONFIG_START_RE)
    )


def is_test_file(path: Column | str) -> Column:
    return is_source_file(path) & F.lower(file_name(path)).rlike(TEST_RE)


def category(path: Column | str) -> Column:
    """config before source; NULL for files that are neither."""
    return F.when(is_config_file(path), "config").when(is_source_file(path), "source")


def is_artifact(path: Column | str) -> Column:
    """Generated files a change set leaves out."""
    return (
        file_name(path).isin(ARTIFACT_NAMES)
        | _col(path).rlike(ARTIFACT_SUFFIX_RE)
        | has_part(path, ARTIFACT_DIRS)
    )


def is_skipped_by_scan(path: Column | str) -> Column:
    """Files below a directory that corpus and test scans leave out."""
    return has_part(path, SCAN_SKIP_DIRS)


def in_corpus(path: Column | str) -> Column:
    return is_source_file(path) & ~is_skipped_by_scan(path)


def service_name(path: Column | str) -> Column:
    """The service a file belongs to, from its directories or its name."""
    inner_first = F.reverse(F.transform(parents(path), F.lower))
    by_dir = F.filter(inner_first, lambda p: p.rlike("[-_]service$"))

    file_stem = F.lower(stem(path))
    name = F.regexp_replace(file_stem, NAME_PREFIX_RE, "")
    name = F.regexp_replace(name, NAME_SUFFIX_RE, "")
    name = F.regexp_replace(name, "^[._\\-]+|[._\\-]+$", "")
    named = F.filter(inner_first, lambda p: ~p.isin(PLAIN_DIRS))
    from_dir = F.regexp_replace(F.get(named, F.lit(0)), "[-_](?:service|api)$", "")

    return (
        F.when(F.size(by_dir) > 0, F.regexp_replace(F.get(by_dir, F.lit(0)), "[-_]service$", ""))
        .when((name != "") & ~name.isin(GENERIC_NAMES), name)
        .when(F.size(named) > 0, from_dir)
        .when(name != "", name)
        .otherwise(file_stem)
    )
