"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits are 32 segments of two. The bit counts of the
segments are a point in {0,1,2}^32, and the Manhattan distance of two points
is never above the Hamming distance of the fingerprints. Points within
distance D that are cut into D + 2 groups of segments agree on at least two
whole groups: these are the axes of the grid. Every point lies in one cell
per pair of groups, points of one cell are compared by Manhattan distance,
and what passes is verified by Hamming distance.

A count of 0, 1 or 2 is kept as the bits 00, 01 or 11, so the Manhattan
distance of two points is the bit count of their exclusive or.

Cases: null and empty texts have fingerprint zero and are linked like any
other; equal fingerprints are one node, so copies cost nothing; rows
repeated with one id give one row each; a null id never names a component
unless all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import connected, small_side
from ripplemark.session import stage

LOW_BITS = 0x5555555555555555
#: Cells with more points than this get representatives before pairs are looked at.
CROWDED = 64
SEEDS = (1, 2, 3, 4)
CHUNK = 1 << 16


def byte_bits() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def octet_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each octet stands at each of the eight places of the 64-bit hashes."""
    octets = hashes.view(np.uint8).reshape(-1, 8)
    return np.bincount((octets + np.arange(8, dtype=np.int64) * 256).ravel(), minlength=2048).reshape(8, 256)


def majority(counts: np.ndarray, total: int, bits: np.ndarray) -> int:
    """The bits set in over half of ``total`` hashes, as a signed number."""
    ones = (counts @ bits).ravel()
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def set_fingerprint(hashes: np.ndarray, bits: np.ndarray) -> int:
    """SimHash of distinct 64-bit hashes; zero of none."""
    counts = np.zeros((8, 256), dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += octet_counts(np.ascontiguousarray(hashes[at : at + CHUNK], dtype="<i8"))
    return majority(counts, len(hashes), bits)


def fingerprint(data: bytes, words: int = 4, bits: np.ndarray | None = None) -> int:
    """64-bit SimHash as a signed number: majority of the shingles' XXH64 (seed 42)."""
    bits = byte_bits() if bits is None else bits
    parts = data.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    width = min(words, len(parts))
    total = len(parts) - width + 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:total].tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros((8, 256), dtype=np.int64)
    for at in range(0, total, CHUNK):
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])]
        counts += octet_counts(np.array(hashes, dtype="<u8"))
    return majority(counts, total, bits)


def fingerprints(rows: DataFrame, words: int = 4) -> DataFrame:
    """The rows with ``fp`` in place of ``body``; the text is read whole, one document at a time."""
    kept = [c for c in rows.columns if c != "body"]

    def read(batches):
        bits = byte_bits()
        for batch in batches:
            found = [fingerprint(t.as_py() or b"", words, bits) for t in batch.column("body").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(found, pa.int64())], [*kept, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "body")
    return rows.select(*kept, "body").mapInArrow(read, f"{schema}, fp bigint")


def popcount_code(fp: Column) -> Column:
    """The bit counts of the 32 segments, each as 00, 01 or 11."""
    low, upper = F.lit(LOW_BITS), F.shiftrightunsigned(fp, 1)
    both = fp.bitwiseAND(upper).bitwiseAND(low)
    either = fp.bitwiseOR(upper).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(either)


def group_masks(groups: int) -> list[int]:
    """The 32 segments dealt into groups of neighbours, as masks of signed 64 bits."""
    edges = [round(32 * i / groups) for i in range(groups + 1)]
    masks = [(1 << 2 * b) - (1 << 2 * a) for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def cells(nodes: DataFrame, distance: int, *carried: str) -> DataFrame:
    """``axes, cell, fp, code`` for every point and pair of groups."""
    code = popcount_code(F.col("fp"))
    masks = group_masks(distance + 2)
    places = [
        F.struct(F.lit(n).alias("axes"), F.col("code").bitwiseAND(F.lit(masks[i] | masks[j])).alias("cell"))
        for n, (i, j) in enumerate(combinations(range(len(masks)), 2))
    ]
    points = nodes.select("fp", code.alias("code"), *carried)
    return points.select(F.explode(F.array(*places)).alias("at"), "fp", "code", *carried).select("at.*", "fp", "code", *carried)


def bits_apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def linked(nodes: DataFrame, distance: int = 4) -> DataFrame:
    """``node, root`` for distinct fingerprints (column ``fp``) that reach another one.

    Links of up to ``distance`` differing bits. Crowded cells first get a few
    representatives, chosen by hash; members near one of them join it. The
    grid join then compares only points whose groups still differ, so a
    large family of near copies yields a few links per member and not all
    its pairs. No cell is cut or skipped: all pairs of different groups in a
    cell are compared.
    """
    placed = cells(nodes, distance)
    picks = [F.min_by("fp", F.xxhash64(F.lit(s), F.col("fp"))).alias(f"pick{s}") for s in SEEDS]
    crowded = placed.groupBy("axes", "cell").agg(F.count(F.lit(1)).alias("n"), *picks).where(F.col("n") > CROWDED)
    crowded = crowded.select("axes", "cell", F.array_distinct(F.array(*[f"pick{s}" for s in SEEDS])).alias("picks"))
    crowded = stage(crowded, "crowded")
    near = placed.join(crowded, ["axes", "cell"]).select(
        "fp", F.filter("picks", lambda p: (p != F.col("fp")) & (F.bit_count(p.bitwiseXOR(F.col("fp"))) <= distance)).alias("near")
    )
    first = connected(near.select(F.col("fp").alias("a"), F.explode("near").alias("b")))
    known = first.select(F.col("node").alias("fp"), "root")
    grouped = stage(nodes.join(known, "fp", "left").select("fp", F.coalesce("root", "fp").alias("family")), "families")
    a = cells(grouped, distance, "family")
    b = a.select("axes", "cell", F.col("fp").alias("fp2"), F.col("code").alias("code2"), F.col("family").alias("family2"))
    pairs = a.join(
        b,
        (a["axes"] == b["axes"])
        & (a["cell"] == b["cell"])
        & (F.col("fp") < F.col("fp2"))
        & (bits_apart("code", "code2") <= distance)
        & (bits_apart("fp", "fp2") <= distance)
        & (F.col("family") != F.col("family2")),
    )
    second = connected(pairs.select(F.col("family").alias("a"), F.col("family2").alias("b")))
    later = second.select(F.col("node").alias("family"), "root")
    return grouped.join(later, "family", "left").select(F.col("fp").alias("node"), F.coalesce("root", "family").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fp, component_id``: component_id is the smallest id reachable over links."""
    bodies = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    rows = stage(fingerprints(bodies, words), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    roots = stage(linked(nodes.select("fp"), distance), "roots")
    members = stage(nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp"), "members")
    named = stage(members.groupBy("root").agg(F.min("least_id").alias("component_id")), "named")
    of_fp = stage(members.join(named, "root").select("fp", "component_id"), "components")
    return rows.join(of_fp, "fp", "left").select("doc_id", "fp", "component_id")


def with_hex(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_name() -> list[Column]:
    """What names a row of documents: its id, null last, and a hash of its text."""
    return [
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"),
    ]


def first_of_each(docs: DataFrame, members: DataFrame) -> DataFrame:
    """All columns of the first row by name of each root. ``members``: names with their ``count`` and ``root``.

    Only the names of the rows that go are joined to the texts, which stay
    in place as long as these names may be broadcast.
    """
    name, keys = row_name(), ["no_id", "id", "h"]
    keepers = stage(members.groupBy("root").agg(F.min(F.struct(*keys)).alias("name")).select("name.*"), "keepers")
    gone = stage(members.join(keepers, keys, "left_anti").select(*keys).distinct(), "gone")
    again = stage(members.where("count > 1").join(keepers, keys, "left_semi").select(*keys), "again")
    left = docs.select(F.struct("*").alias("row"), *name).join(small_side(gone), keys, "left_anti")
    if not again.isEmpty():
        twice = small_side(again)
        once = left.join(twice, keys, "left_semi").dropDuplicates(keys)
        left = left.join(twice, keys, "left_anti").union(once)
    return left.select("row.*")


def one_of_each(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """All columns of the documents that stay: of each component the row with the smallest doc_id.

    A null doc_id comes last, equal ids are told apart by a hash of the
    text, and rows equal in both are one document.
    """
    rows = stage(fingerprints(docs.select(*row_name(), F.col("text").cast("string").alias("body")), words), "fingerprints")
    roots = stage(linked(rows.select("fp").distinct(), distance), "roots").select(F.col("node").alias("fp"), "root")
    return first_of_each(docs, stage(rows.groupBy("no_id", "id", "h", "fp").count().join(roots, "fp"), "members"))
