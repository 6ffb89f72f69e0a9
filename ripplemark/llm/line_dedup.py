"""Boilerplate lines by their frequency within one host.

A line's ratio is the number of the host's pages that contain it, over all
pages of the host. Lines whose ratio exceeds a limit are dropped from every
page of that host. Lines are compared without surrounding spaces and tabs;
blank lines are never boilerplate. A line must be on a few pages (``support``)
before its ratio means anything: on a host with two pages every line that
both have would have ratio 1.

Cases: a null host is a host of its own; a null text stays null; a page
that repeats a line counts once, and loses all its copies; rows repeated
with one id are pages of their own, unless copies count once; an empty table gives an empty result;
all other columns of the input are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import text_of
from ripplemark.session import stage

RATIO = 0.05
SUPPORT = 3


def key_hash(line: Column) -> Column:
    """128 bits of the trimmed line; null for a blank one."""
    key = F.trim(line, F.lit(" \t\r"))
    return F.when(key != "", F.struct(F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, support: int = SUPPORT, copies: bool = True) -> DataFrame:
    """``host, h, g, pages, total``: the lines to drop, by hash.

    Without ``copies``, pages of one host with equal text are one page.

    Pages are counted per (host, line) within each task first; the page
    totals ride along as a line without hash, so they come out of the same
    aggregation.
    """
    host = F.col(host_col).cast("string")
    lines = F.array_distinct(F.transform(F.split(text_of(text_col), "\n"), key_hash))
    none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("bigint").alias("g"))
    marked = F.concat(F.filter(lines, lambda x: x.isNotNull()), F.array(none))
    pages = docs.select(host.alias("host"), marked.alias("lines"), *[F.xxhash64(F.lit(k), text_of(text_col)).alias(f"text{k}") for k in (1, 2) if not copies])
    pages = pages if copies else pages.distinct()
    each = pages.select("host", F.explode("lines").alias("line")).select("host", "line.h", "line.g")
    counts = stage(each.groupBy("host", "h", "g").agg(F.count(F.lit(1)).alias("pages")).where(f"h is null or pages >= {int(support)}"), "lines")
    totals = counts.where("h is null").select(F.col("host").alias("site"), F.col("pages").alias("total"))
    often = counts.where("h is not null").join(F.broadcast(totals) if totals.count() < 100_000 else totals, F.col("host").eqNullSafe(F.col("site")))
    return often.where(F.col("pages") > F.col("total") * ratio).select("host", "h", "g", "pages", "total")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, support: int = SUPPORT, copies: bool = True) -> DataFrame:
    """All rows and columns, the text without its host's boilerplate lines.

    ``copies``: whether equal texts of a host count as pages of their own.

    The hashes to drop of one host are at most the lines of an average page
    over ``ratio`` (each is on more than that share of the pages), so they
    travel as one array per host; the planner broadcasts the hosts if their
    size allows and splits a skewed host otherwise.
    """
    lines = boilerplate(docs, host_col, text_col, ratio, support, copies)
    sites = stage(lines.groupBy("host").agg(F.collect_set(F.struct("h", "g")).alias("drop")), "sites")
    rows = docs.select(F.struct("*").alias("row"), F.col(host_col).cast("string").alias("host"))
    body = F.col("row")[text_col].cast("string")
    kept = F.filter(F.split(body, "\n"), lambda x: ~F.coalesce(F.array_contains("drop", key_hash(x)), F.lit(False)))
    cleaned = F.when(F.col("drop").isNull() | body.isNull(), body).otherwise(F.array_join(kept, "\n"))
    done = rows.join(sites.withColumnRenamed("host", "site"), F.col("host").eqNullSafe(F.col("site")), "left")
    done = done.select("row", cleaned.alias("body"))
    return done.select(*[(F.col("body") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = RATIO, support: int = SUPPORT) -> DataFrame:
    """Per row: the cleaned text and how many lines it had and lost."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    narrow = narrow.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("bigint"))
    return drop_boilerplate(narrow, "host", "text", ratio, support).select(
        "doc_id",
        "text",
        "n_lines",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
