"""Services a change touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions import paths as P
from ripplemark.operators.configs import manifest_services

# ---- fixed values ----
MENTION_RE = "(?:name|app|value):\\s*[\"']?([a-z][a-z0-9\\-]*(?:service|cart|frontend[a-z\\-]*))"
KEY_PREFIXES = ["Deployment/", "Service/", "StatefulSet/"]
# ---- end of fixed values ----


def services_from_paths(changes: DataFrame) -> DataFrame:
    """Service names read off the changed source and config paths."""
    return (
        changes.filter(F.col("category").isNotNull())
        .select(P.service_name("path").alias("service"))
        .filter("service <> ''")
        .distinct()
    )


def service_mentions(lines: DataFrame) -> DataFrame:
    """Service names that changed lines mention: distinct ``(path, service)``."""
    found = F.regexp_extract_all("line", F.lit(MENTION_RE), F.lit(1))
    return lines.select("path", F.explode(found).alias("service")).distinct()


def services_in_keys(keys: DataFrame) -> DataFrame:
    """Service names behind the workload prefixes of changed keys."""
    found = F.array(*[F.regexp_extract("key", f"{p}([^.]*)", 1) for p in KEY_PREFIXES])
    return keys.select(F.explode(found).alias("service")).filter("service <> ''").distinct()


def affected_services(changes: DataFrame, lines: DataFrame, new_files: DataFrame) -> DataFrame:
    """Union over paths, changed config lines, and manifests whose contents are equal.

    ``changes`` carries a category, ``lines`` are the changed lines.
    """
    configs = changes.filter(F.col("category") == "config").select("path")
    in_lines = service_mentions(lines.join(configs, "path", "left_semi")).select("service")
    silent = configs.join(lines.select("path").distinct(), "path", "left_anti")
    silent_files = new_files.filter(P.extension("path").isin("yaml", "yml")).join(silent, "path", "left_semi")
    in_manifests = manifest_services(silent_files).select("service")
    return services_from_paths(changes).union(in_lines).union(in_manifests).distinct()
