"""Exact duplicates by progressive refinement: length, prefix hash, full hash.

Cases: a null text equals the empty text; a null id never wins unless all
ids of the group are null; rows repeated with the same id and text are all
reported alike; an empty table gives an empty result. Columns beyond the id
and the text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import text_of
from ripplemark.session import stage

#: Characters in the hash of the second level.
PREFIX = 128
#: Keys of surviving groups that may be broadcast: 8 bytes each, 16 MB.
SMALL_KEYS = 2_000_000


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def repeated_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX) -> DataFrame:
    """One row per text that occurs more than once: ``digest``, ``keep_id``, ``group_size``.

    ``keep_id`` is the largest id of the group. Lengths that occur once drop
    out first, then (length, prefix hash) pairs that occur once; the full
    content is hashed only for rows that are left. What moves between tasks
    are numbers and digests, pre-aggregated by task, so a text that makes up
    a third of the table sends one row per task. Texts themselves move only
    if the surviving keys are too many to broadcast.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body"))
    size = F.octet_length("body")
    sizes = stage(rows.groupBy(size.alias("size")).count().where("count > 1").select("size"), "sizes")
    keyed = rows.select("id", "body", size.alias("size"))
    start = F.xxhash64(F.col("size"), F.substring("body", 1, prefix)).alias("start")
    starts = keyed.select("size", start).join(sizes, "size", "left_semi")
    starts = stage(starts.groupBy("start").count().where("count > 1").select("start"), "starts")
    small = starts.count() <= SMALL_KEYS
    left = keyed.select("id", "body", start).join(F.broadcast(starts) if small else starts, "start", "left_semi")
    full = left.select("id", digest(F.col("body")).alias("digest"))
    groups = full.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return groups.where("group_size > 1")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its group: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    groups = stage(repeated_texts(docs, id_col, text_col), "groups")
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(text_of(text_col)).alias("digest"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
