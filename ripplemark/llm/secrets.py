"""Secrets by pattern, told apart by how widely each candidate is owned.

Base patterns give spans; further patterns add spans of well-known token
shapes. Every candidate value is hashed and counted over the whole corpus by
distinct repositories and owners: a value that many owners have is a copied
example, one that a single owner has looks live.

All of it is DataFrame expressions. Offsets come from the pieces between
matches: ``split`` and ``regexp_extract_all`` with one pattern give the gaps
and the matches in order, and running sums of their lengths (code points)
give the places.

Cases: a null text is empty and has no spans; a null owner or repository is
one owner or repository of its own; a document is its own repository unless a
column is named; rows of one id, or without id, are each judged by their own
spans, and those repeated whole count once per owner; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import text_of
from ripplemark.session import stage

ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Base kinds in their order: pattern, group that holds the value, least length of that group.
BASE = [
    ("assign", ASSIGN, 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: Further shapes; spans that a base span of the same kind cannot be.
MORE = [
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    ("prefixed", r"(?:gh[opsu]|xox[abp]|sk|pk|glpat)[_-][A-Za-z0-9_-]{16,}", 0, 19),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 20),
]
#: A value of at least this many distinct owners is an example.
SHARED_BY = 3

# A cheap test for each pattern; a text without it has no match.
HINTS = {
    "assign": r"(?i)(?:password|passwd|secret|token|api_?key)",
    "access": "AKIA",
    "hex": r"[0-9a-f]{16}",
    "jwt": "eyJ",
    "prefixed": r"[abkopstu][_-][A-Za-z0-9_-]{16}",
    "private_key": "PRIVATE KEY-----",
}


def running_sum(numbers: Column) -> Column:
    """Sums of the first 1, 2, … numbers, by doubling: n log n steps for n numbers."""
    top = F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)).cast("double"))).cast("int")
    steps = F.when(F.size(numbers) < 2, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(0), top - 1), lambda k: F.pow(F.lit(2.0), k).cast("int"))
    )
    shifted = lambda acc, by: F.slice(F.concat(F.array_repeat(F.lit(0), by), acc), F.lit(1), F.size(acc))
    return F.aggregate(steps, numbers, lambda acc, by: F.zip_with(acc, shifted(acc, by), lambda x, y: x + y))


def matches(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Spans of one kind: array of ``start, rank, kind, end, value`` by start."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    lengths = F.zip_with(gaps, found, lambda g, m: F.char_length(g) + F.char_length(m))
    span = lambda m, e: F.struct(
        (e - F.char_length(m)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), e.alias("end")
    )
    spans = F.zip_with(found, running_sum(lengths), span)
    full = F.zip_with(spans, values, lambda s, v: F.struct(s["start"], s["rank"], s["kind"], s["end"], v.alias("value")))
    kept = F.filter(full, lambda s: F.char_length(s["value"]) >= least)
    return F.when(F.regexp_like(text, F.lit(HINTS[kind])), kept).otherwise(F.array().cast(SPANS))


SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    ordered = F.sort_array(spans)
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """Every row with its spans, to be staged at once: ``row`` (a number of its own), ``doc_id, owner, repo, base, more``."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text_of(text_col).alias("body"),
        F.col(owner_col).cast("string").alias("owner"),
        F.col(repo_col).cast("string").alias("repo"),
    )
    kinds = [(kind, n, *rest) for n, (kind, *rest) in enumerate(BASE + MORE)]
    found = rows.select("doc_id", "owner", "repo", *[matches(F.col("body"), *k).cast(SPANS).alias(k[0]) for k in kinds])
    base, more = ([k[0] for k in part] for part in (BASE, MORE))
    return found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repo", *base, F.concat(*base).alias("base"), F.concat(*more).alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """``value_hash, repos, owners`` of every candidate value, over all rows.

    Values are counted per owner first, so a value in a third of all rows
    sends one row per task, owner and repository.
    """
    each = found.where((F.size("base") > 0) | (F.size("more") > 0)).select(
        F.coalesce("owner", F.lit("")).alias("owner"),
        F.coalesce("repo", F.lit("")).alias("repo"),
        F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda s: F.sha2(s["value"], 256)))).alias("value_hash"),
    )
    by_repo = each.distinct()
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("value_hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", shared_by: int = SHARED_BY) -> DataFrame:
    """One row per span of every text: ``doc_id, kind, start, end, value_hash, repos, owners, verdict``.

    ``verdict`` is ``example`` for values that at least ``shared_by`` owners
    have and ``live`` otherwise.
    """
    found = stage(candidates(docs, id_col, text_col, owner_col, repo_col), "candidates")
    return judged(found, shared_by).drop("row")


def judged(found: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    owned = stage(ownership(found), "ownership")
    spans = found.select("row", "doc_id", F.explode(F.concat("base", "more")).alias("span")).select(
        "row", "doc_id", "span.kind", "span.start", "span.end", F.sha2("span.value", 256).alias("value_hash")
    )
    verdict = F.when(F.col("owners") >= shared_by, "example").otherwise("live")
    return spans.join(owned, "value_hash").select("row", "doc_id", "kind", "start", "end", "value_hash", "repos", "owners", verdict.alias("verdict"))


def secret_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", shared_by: int = SHARED_BY) -> DataFrame:
    """Per row: counts and digest of the base spans, all spans, and how many values look live or copied."""
    found = stage(candidates(docs, id_col, text_col, owner_col, repo_col), "candidates")
    verdicts = judged(found, shared_by).groupBy("row").agg(
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if(F.col("verdict") == "example").alias("n_example")
    )
    verdicts = stage(verdicts, "verdicts")
    counted = found.select(
        "row", "doc_id",
        *[F.size(kind).cast("bigint").alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "more")).alias("spans"),
    )
    zero = F.lit(0).cast("bigint")
    return counted.join(verdicts, "row", "left").drop("row").withColumns({c: F.coalesce(c, zero) for c in ("n_live", "n_example")})
