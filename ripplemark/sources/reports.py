"""The result of an impact run: writing it and reading results back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = (
    "affected_tests array<string>, has_affected_tests boolean, test_count bigint, "
    "summary struct<changed_files:array<string>, source_files:array<string>, config_files:array<string>, "
    "total_tests_analyzed:bigint, affected_tests_count:bigint>"
)
SECTIONS = ["affected_tests", "changed_files", "source_files", "config_files"]
ENTRY_SCHEMA = "section string, path string, score double"


def report_entries(changes: DataFrame, ranked: DataFrame) -> DataFrame:
    """The lists of a result as rows: ``(section, path, score)``."""
    no_score = F.lit(None).cast("double").alias("score")
    changed = changes.select(F.lit("changed_files").alias("section"), "path", no_score)
    by_kind = changes.filter(F.col("category").isNotNull()).select(
        F.concat("category", F.lit("_files")).alias("section"), "path", no_score
    )
    affected = ranked.select(F.lit("affected_tests").alias("section"), "path", "score")
    return changed.unionByName(by_kind).unionByName(affected)


def report_summary(entries: DataFrame, total_tests: DataFrame) -> DataFrame:
    """One row: flag, counts and totals of a result."""

    def count(section: str) -> Column:
        return F.count_if(F.col("section") == section)

    return entries.agg(
        (count("affected_tests") > 0).alias("has_affected_tests"),
        count("affected_tests").alias("test_count"),
        count("changed_files").alias("n_changed_files"),
        count("source_files").alias("n_source_files"),
        count("config_files").alias("n_config_files"),
    ).withColumn("total_tests_analyzed", total_tests.agg(F.count("*")).scalar())


def write_report(entries: DataFrame, summary: DataFrame, path: str) -> None:
    """JSON lines: ``entries/`` partitioned by section and one-row ``summary/``.

    Lists stay rows, so a change set of any size is written by many tasks.
    """
    entries.write.mode("overwrite").partitionBy("section").json(f"{path}/entries")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


def document_lines(entries: DataFrame, summary: DataFrame) -> DataFrame:
    """The lines of one JSON document of RESULT_SCHEMA, tests best first: ``(part, place, path, line)``.

    Every entry is a line of its own; sorted by the first three columns the
    lines are the document. Its lists are never gathered, whatever their
    length.
    """
    place = F.when(F.col("section") == "affected_tests", -F.col("score")).otherwise(0.0)
    kept = entries.filter(F.col("section").isin(SECTIONS))
    part = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")).cast("int") * 2 - 1
    placed = kept.select("section", part.alias("part"), place.alias("place"), "path")
    first = placed.groupBy("section").agg(F.min(F.struct("place", "path")).alias("first"))
    text = F.to_json(F.array("path"))
    quoted = F.substr(text, F.lit(2), F.length(text) - 2)
    comma = F.when(F.struct("place", "path") == F.col("first"), "").otherwise(",")
    items = placed.join(first, "section").select("part", "place", "path", F.concat(comma, quoted).alias("line"))

    n, total = F.col("test_count").cast("string"), F.col("total_tests_analyzed").cast("string")
    between = [
        F.lit('{"affected_tests":['),
        F.concat(
            F.lit('],"has_affected_tests":'), F.col("has_affected_tests").cast("string"), F.lit(',"test_count":'), n,
            F.lit(',"summary":{"changed_files":['),
        ),
        F.lit('],"source_files":['),
        F.lit('],"config_files":['),
        F.concat(F.lit('],"total_tests_analyzed":'), total, F.lit(',"affected_tests_count":'), n, F.lit("}}")),
    ]
    frame = [
        F.struct(F.lit(2 * i).alias("part"), F.lit(0.0).alias("place"), F.lit("").alias("path"), line.alias("line"))
        for i, line in enumerate(between)
    ]
    return items.unionByName(summary.select(F.inline(F.array(*frame))))


def write_document(entries: DataFrame, summary: DataFrame, path: str) -> None:
    """The result as one JSON document in text parts; their concatenation by name is the document.

    One range sort orders the lines, so a result of any length is written
    by many tasks. :func:`write_report` keeps the lists as rows instead.
    """
    lines = document_lines(entries, summary).orderBy("part", "place", "path")
    lines.select("line").write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a written report."""
    return spark.read.schema(ENTRY_SCHEMA).json(f"{path}/entries")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Single-document results, one JSON object per file."""
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", "true").json(path)


def summarize_documents(documents: DataFrame) -> DataFrame:
    """Flag, counts and list sizes of result documents, absent parts as defaults."""

    def length(column: str) -> Column:
        return F.coalesce(F.when(F.col(column).isNotNull(), F.size(column)), F.lit(0))

    return documents.select(
        F.coalesce("has_affected_tests", F.lit(False)).alias("has_affected_tests"),
        F.coalesce("test_count", F.lit(0)).alias("test_count"),
        length("summary.changed_files").alias("n_changed_files"),
        length("summary.source_files").alias("n_source_files"),
        length("summary.config_files").alias("n_config_files"),
        F.coalesce("summary.total_tests_analyzed", F.lit(0)).alias("total_tests_analyzed"),
        length("affected_tests").alias("n_affected_tests"),
    )
