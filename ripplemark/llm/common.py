"""Small helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.session import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers each that may be broadcast: 40 MB at most.
SMALL_ROWS = 1_000_000


def small_side(keys: DataFrame) -> DataFrame:
    """A written table of a few numbers per row, broadcast if its rows are few enough; counted first."""
    return F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys


def text_of(column: str | Column) -> Column:
    """The text, null read as empty."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))


def kept_by_worker(kind: str, key: str, make):
    """An object that outlives the task in a reused worker; only the latest one, so that stages don't add up.

    What earlier stages have used and freed goes back to the system first, what making the object has used goes back then.
    """
    held = sys.__dict__.setdefault("_ripplemark_kept", [])
    if not held or held[0][0] != (kind, key):
        held.clear()
        give_back()
        held.append(((kind, key), make()))
        give_back()
    return held[0][1]


def give_back() -> None:
    """Freed memory of this worker goes back to the system; glibc keeps what lies below memory in use unless it is told."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def connected(edges: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges``: ``a``, ``b`` (bigint, any order, repeats allowed). Result:
    ``node``, ``root``; nodes without an edge to another node are absent.

    Each round lets every node point to its smallest neighbour, follows the
    pointers to their roots by doubling, and keeps only the edges between
    different roots. At least half of the nodes that still have edges merge
    per round. Only minima and equality joins are used, so a node with very
    many edges is pre-aggregated and split like any skewed key. Every step
    is a table in the shared folder.
    """
    ordered = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = stage(ordered.distinct(), "edges")
    found = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))
        hooks = stage(hooks, "hooks")
        while True:
            far = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = stage(hooks.join(far, "root").select("node", "next", (F.col("root") != F.col("next")).alias("moved")), "jump")
            moved = not jumped.where("moved").isEmpty()
            hooks = jumped.select("node", F.col("next").alias("root"))
            if not moved:
                break
        if found is None:
            found = hooks
        else:
            later = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = stage(
                found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots"
            )
        a, b = (hooks.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
        left = left.join(a, "a").join(b, "b").where("root_a <> root_b")
        left = stage(left.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), "edges")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
