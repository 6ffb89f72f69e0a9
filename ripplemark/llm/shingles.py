"""Near copies by SimHash, verified on word shingles, and an exact way for the rest.

Two texts are near copies if the Jaccard similarity of their sets of word
shingles reaches a limit t. First comes SimHash: each set has a 64-bit
fingerprint, the segment-popcount grid of ``simhash`` links fingerprints of
few differing bits, and each node of a linked family is verified on whole
sets against the family's first. What is verified is one family in all that
follows, and shingles that only one family has are not looked at again.

A fingerprint cannot promise all pairs: texts of similarity 0.8 differ by
about 10 of 64 bits and some by twice that. So the rest of the candidates
come from a prefix filter, which loses none: put in one order,
two sets of similarity t share one of their first n - ceil(t n) + 1 shingles
each, and what follows a shared shingle bounds the overlap still possible.
Shingles that a sample shows to be frequent come last in the order, so they
are seldom looked at; any order gives the same result.

A large group of copies of one text is a cluster. Every node (texts of equal
sets) that has crowded shingles is compared with one other node only, the
most central of those that share one. What differs from that centre is a
node's delta, and the sets of two nodes of a cluster differ by the symmetric
difference of their deltas: they are similar exactly if that is at most
(1 - t) / (1 + t) of the sum of their sizes. So within a cluster nodes are
joined by what their deltas share, again by a prefix filter with bounds, and
not by the text that all of them share. Nodes similar to their centre are one
family at once; in a few rounds each node is compared with the most central
node that shares a crowded piece of its delta; then all nodes of different
families that may be similar are compared. Nodes of different clusters, or of
none, meet by their shingles. No list is cut or skipped.

Pairs that meet are first held against sketches: 256 places of which a set
changes one with each of its shingles, within the join, so that pairs that
share a passage and no more are not shuffled; then as many places as there
are shingles; then the whole sets. Sketches differ at no more places than
the sets have shingles apart, so that no similar pair is lost.

Cases: words are runs of non-space bytes in lower case (A-Z), as in
``simhash``; a text of fewer words is one shingle; null and texts without
words are copies of each other; rows and ids as in ``simhash.one_of_each``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.llm.common import connected, small_side
from ripplemark.llm.simhash import byte_bits, first_of_each, linked, row_name, set_fingerprint
from ripplemark.session import passing_stages, stage

WORDS, SIMILARITY = 5, 0.8
#: Bits by which fingerprints of one SimHash family may differ.
DISTANCE = 4
#: Texts whose shingles are counted for the order, in how many of them a shingle is frequent, and how many such shingles
#: the order knows at most (16 bytes each; it is an order only, so that nothing depends on it but the time).
SAMPLE, OFTEN, ORDERED = 8_000, 6, 200_000
#: What more nodes than this share is crowded.
CROWDED = 64
#: Similarity to a centre below which a node is of no cluster, and rounds of single comparisons within clusters.
FLOOR, ROUNDS = 0.5, 3
#: Pieces of deltas that a task holds before it hands them on.
HELD = 200_000
#: Columns of the short sketch, 64 places each.
SKETCH = [f"odd{i}" for i in range(4)]


def shingle_set(data: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct XXH64 of the shingles, sorted."""
    parts = data.lower().split()
    if not parts:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    width = min(words, len(parts))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], dtype="<u8").view("<i8"))


def node_of(shingles: np.ndarray) -> int:
    found = xxhash.xxh64_intdigest(shingles.tobytes(), 42)
    return found - (1 << 64) if found >> 63 else found


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Which of as many places as there are shingles, a power of two, an odd number of them falls on; as signed numbers.

    A shingle that only one of two sets has changes one place, so sketches
    never differ at more places than the sets have shingles apart.
    """
    places = max(64 * len(SKETCH), 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount(shingles & (places - 1), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded(odd: np.ndarray, length: int) -> np.ndarray:
    """The sketch of the same set in ``length`` numbers."""
    return np.bitwise_xor.reduce(odd.reshape(-1, length), axis=0)


def frequent(bodies: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of distinct texts, sorted, and their counts."""
    n = bodies.count()
    share = F.xxhash64(F.lit("order"), "body") / F.lit(2.0**64) + 0.5
    some = bodies.where("body is not null").where(share < SAMPLE / max(n, 1)).select("body").distinct()

    def read(batches):
        for batch in batches:
            for text in batch.column(0).cast(pa.large_binary()):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), words))], ["s"])

    often = some.mapInArrow(read, "s bigint").groupBy("s").count().where(F.col("count") >= OFTEN)
    often = sorted(often.orderBy(F.desc("count"), "s").limit(ORDERED).collect())
    return np.array([r["s"] for r in often], dtype=np.int64), np.array([r["count"] for r in often], dtype=np.int64)


def prefixes(rows: DataFrame, order: tuple[np.ndarray, np.ndarray], words: int, similarity: float) -> DataFrame:
    """The rows with ``node, n, rare, fp, prefix, sketch`` and the columns of the short sketch in place of ``body``.

    ``rare`` counts shingles that the order does not know, ``fp`` is the SimHash of the set.
    """
    kept = [c for c in rows.columns if c != "body"]
    shared = rows.sparkSession.sparkContext.broadcast(order)

    def read(batches):
        common, counts = shared.value
        bits = byte_bits()
        for batch in batches:
            nodes, sizes, rare, prints, found, sketches, short = [], [], [], [], [], [], []
            for text in batch.column("body").cast(pa.large_binary()):
                own = shingle_set(text.as_py() or b"", words)
                nodes.append(node_of(own))
                sizes.append(len(own))
                prints.append(set_fingerprint(own, bits))
                sketches.append(sketch(own))
                short.append(folded(sketches[-1], len(SKETCH)))
                # The allowance keeps a product like 0.8 * 5 from being rounded up.
                length = len(own) - math.ceil(similarity * len(own) - 1e-9) + 1 if len(own) else 0
                unknown = len(own)
                if len(common):
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    known = np.where(common[at] == own, counts[at], 0)
                    own, unknown = own[np.lexsort((own, known))], int((known == 0).sum())
                rare.append(unknown)
                found.append(own[:length])
            columns = [pa.array(x, pa.int64()) for x in (nodes, sizes, rare, prints)] + [pa.array(found, pa.list_(pa.int64()))]
            columns.append(pa.array([x.tobytes() for x in sketches], pa.binary()))
            columns += [pa.array(x, pa.int64()) for x in np.array(short, dtype=np.int64).reshape(-1, len(SKETCH)).T]
            names = [*kept, "node", "n", "rare", "fp", "prefix", "sketch", *SKETCH]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *columns], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "body")
    schema += ", node bigint, n bigint, rare bigint, fp bigint, prefix array<bigint>, sketch binary"
    return rows.select(*kept, "body").mapInArrow(read, schema + "".join(f", {c} bigint" for c in SKETCH))


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """``node, shingles`` of the rows' ``node, body``, the set as sorted 64-bit numbers."""

    def read(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", words).tobytes() for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    return rows.select("node", "body").mapInArrow(read, "node bigint, shingles binary")


def sets_of(nodes: DataFrame, bodies: DataFrame, names: DataFrame, words: int) -> DataFrame:
    """``node, shingles`` of the ``nodes``. ``names``: one row's name for each node."""
    keys = [c for c in bodies.columns if c != "body"]
    wanted = stage(names.join(nodes.distinct(), "node", "left_semi"), "wanted")
    texts = bodies.join(small_side(wanted), keys).select("node", "body")
    return stage(shingle_sets(texts, words).dropDuplicates(["node"]), "sets")


def both_ends(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` with ``set_a, set_b``."""
    a, b = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` of the pairs whose sets are similar."""

    def read(batches):
        for batch in batches:
            keep = []
            for one, other in zip(batch.column(2), batch.column(3)):
                p, q = (np.frombuffer(x.as_py(), dtype=np.int64) for x in (one, other))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both / (len(p) + len(q) - both) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both_ends(pairs, sets).select("a", "b", "set_a", "set_b").mapInArrow(read, "a bigint, b bigint")


def deltas(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``node, centre, n, size, linked, delta`` of the pairs ``a`` (node), ``b`` (centre) that are not too far apart."""

    names = ["node", "centre", "n", "size", "linked", "delta"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]

    def compared(batches):
        for batch in batches:
            for node, centre, one, other in zip(*batch.columns):
                p, q = (np.frombuffer(x.as_py(), dtype=np.int64) for x in (one, other))
                delta = np.setxor1d(p, q, assume_unique=True)
                both = (len(p) + len(q) - len(delta)) // 2
                alike = both / (len(p) + len(q) - both)
                if alike >= FLOOR:
                    yield node.as_py(), centre.as_py(), len(p), len(delta), alike >= similarity, delta

    def read(batches):
        held, pieces = [], 0
        for row in compared(batches):
            held.append(row)
            pieces += len(row[-1])
            if pieces >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                held, pieces = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    schema = "node bigint, centre bigint, n bigint, size bigint, linked boolean, delta array<bigint>"
    return both_ends(pairs, sets).select("a", "b", "set_a", "set_b").mapInArrow(read, schema)


def up(x: Column) -> Column:
    """The next whole number; the allowance keeps a product like 0.8 * 5 from being rounded up."""
    return F.ceil(x - F.lit(1e-9))


def overlap_wanted(similarity: float, n: str = "n", n2: str = "n2") -> Column:
    """Shingles that sets of sizes ``n`` and ``n2`` must share."""
    return up((F.col(n) + F.col(n2)) * F.lit(similarity / (1 + similarity)))


def most_apart(similarity: float, n: str = "n", n2: str = "n2") -> Column:
    """Shingles that similar sets of sizes ``n`` and ``n2`` may have that the other lacks, on both sides together."""
    return F.col(n) + F.col(n2) - 2 * overlap_wanted(similarity, n, n2)


def sketches_fit(similarity: float, a: str, b: str) -> Column:
    """Whether rows ``a`` and ``b`` may be similar by their sizes and short sketches; false for no similar ones."""
    apart = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH), F.lit(0))
    return apart <= most_apart(similarity, f"{a}.n", f"{b}.n")


def promising(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """``a, b`` of the pairs that may be similar by their ``sketches`` (``node, n, sketch``); no similar one is lost."""

    def read(batches):
        for batch in batches:
            keep = []
            for one, other, most in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist()):
                # Unsigned, for of a negative number numpy counts the bits of its absolute value.
                p, q = (np.frombuffer(x.as_py(), dtype=np.uint64) for x in (one, other))
                length = min(len(p), len(q))
                keep.append(int(np.bitwise_count(folded(p, length) ^ folded(q, length)).sum()) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sketches.select(F.col("node").alias("a"), "n", "sketch")
    two = sketches.select(F.col("node").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2"))
    both = pairs.join(one, "a").join(two, "b")
    return both.select("a", "b", "sketch", "sketch2", most_apart(similarity).alias("most")).mapInArrow(read, "a bigint, b bigint")


def with_family(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with the ``family`` of their node: its root if it has one."""
    return rows.join(known, "node", "left").withColumn("family", F.coalesce("root", "node")).drop("root")


def edges_of(known: DataFrame) -> DataFrame:
    return known.select(F.col("node").alias("a"), F.col("root").alias("b"))


def pieces(close: DataFrame, similarity: float) -> DataFrame:
    """What nodes of a cluster share of their deltas: ``centre, m, node, weight, left``.

    Rarest first within the cluster; ``left`` is how many pieces follow. Two
    nodes are similar only if they share half the sum of their weights.
    """
    weight = F.col("size") - F.col("n") * F.lit((1 - similarity) / (1 + similarity))
    each = close.select("centre", "node", weight.alias("weight"), F.explode("delta").alias("m"))
    held = each.groupBy("centre", "m").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    own = Window.partitionBy("centre", "node").orderBy(F.desc("nodes"), "m")
    return each.join(held, ["centre", "m"]).select("centre", "m", "node", "weight", (F.row_number().over(own) - 1).alias("left"))


def may_reach(weight: str, weight2: str, left: str, left2: str) -> Column:
    return F.lit(1) + F.least(left, left2) >= up((F.col(weight) + F.col(weight2)) / 2)


def in_clusters(close: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` that join all nodes of one cluster that are to be joined."""
    links = close.where("linked").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    known = stage(connected(links), "families")
    marks = stage(pieces(close, similarity), "pieces")
    for _ in range(ROUNDS):
        now = stage(with_family(marks, known), "placed")
        pick = F.min(F.struct("weight", F.xxhash64("node").alias("h"), "node", "family", "left")).alias("pick")
        crowded = now.groupBy("centre", "m").agg(F.count(F.lit(1)).alias("nodes"), F.min("family").alias("lo"), F.max("family").alias("hi"), pick)
        crowded = stage(crowded.where(F.col("nodes") > CROWDED).where("lo <> hi").select("centre", "m", "pick"), "crowded")
        met = now.join(crowded, ["centre", "m"]).where("family <> pick.family")
        met = met.where(may_reach("weight", "pick.weight", "left", "pick.left")).groupBy("node").agg(F.min("pick").alias("pick"))
        found = stage(similar(met.select(F.col("node").alias("a"), F.col("pick.node").alias("b")), sets, similarity), "joined")
        if found.isEmpty():
            break
        known = stage(connected(edges_of(known).union(found)), "families")
    now = stage(with_family(marks, known), "placed")
    mixed = stage(now.groupBy("centre", "m").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi").select("centre", "m"), "mixed")
    a = stage(now.join(small_side(mixed), ["centre", "m"], "left_semi"), "left")
    b = a.select("centre", "m", *[F.col(c).alias(f"{c}2") for c in ("node", "weight", "left", "family")])
    apart = (F.col("family") < F.col("family2")) & may_reach("weight", "weight2", "left", "left2")
    pairs = a.join(b, (a["centre"] == b["centre"]) & (a["m"] == b["m"]) & apart)
    pairs = stage(pairs.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct(), "candidates")
    return edges_of(known).union(stage(similar(pairs, sets, similarity), "verified"))


def simhash_links(rows: DataFrame, bodies: DataFrame, words: int, similarity: float, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: nodes and the first node of their SimHash family, where their sets are similar. ``rows``: names with ``node, fp``."""
    keys = [c for c in bodies.columns if c != "body"]
    roots = stage(linked(rows.select("fp").distinct(), distance), "fingerprints")
    placed = rows.join(roots.select(F.col("node").alias("fp"), "root"), "fp").groupBy("node", "root")
    placed = stage(placed.agg(F.min(F.struct(*keys)).alias("name")).select("node", "root", "name.*"), "nodes")
    first = placed.groupBy("root").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("root", "b")
    pairs = stage(placed.join(first, "root").where("node <> b").select(F.col("node").alias("a"), "b"), "likely")
    sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), bodies, placed.drop("root"), words)
    return similar(pairs, sets, similarity)


def near_copies(rows: DataFrame, bodies: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``node, root`` of the nodes that reach another one. ``rows``: names with what ``prefixes`` gives."""
    with passing_stages(rows.sparkSession) as keep:
        alike = keep(simhash_links(rows, bodies, words, similarity), "alike")
    with passing_stages(rows.sparkSession) as keep:
        return keep(exact_rest(rows, bodies, alike, words, similarity), "roots")


def exact_rest(rows: DataFrame, bodies: DataFrame, alike: DataFrame, words: int, similarity: float) -> DataFrame:
    """``node, root`` of the nodes that reach another one, by the links ``alike`` and all others there are."""
    keys = [c for c in bodies.columns if c != "body"]
    of_family = small_side(stage(connected(alike), "families"))
    # Each shingle of a prefix is dealt out once, for the count of its families and for the choice by that count.
    held = with_family(rows.select("node", "n", "rare", "prefix"), of_family)
    held = held.select("node", "family", "n", "rare", F.posexplode("prefix").alias("place", "s"))
    of_shingle = Window.partitionBy("s")
    held = held.withColumns({"lo": F.min("family").over(of_shingle), "hi": F.max("family").over(of_shingle)}).where("lo <> hi")
    posts = stage(held.select("node", "n", "rare", "place", "s").distinct(), "postings")
    named = [F.min(F.struct(*keys)).alias("name"), *(F.min(c).alias(c) for c in SKETCH)]
    names = rows.select(*keys, "node", *SKETCH).join(posts.select("node").distinct(), "node", "left_semi")
    names = stage(names.groupBy("node").agg(*named).select("node", "name.*", *SKETCH), "names")
    sketches, names = names.select("node", *SKETCH), names.drop(*SKETCH)
    fits = lambda m, n, limit: F.least(m, n) / F.greatest(m, n) >= limit
    pick = F.min(F.struct("rare", F.xxhash64("node").alias("h"), "node", "n")).alias("pick")
    crowded = posts.groupBy("s").agg(F.count(F.lit(1)).alias("nodes"), pick).where(F.col("nodes") > CROWDED)
    crowded = stage(crowded.select("s", "pick"), "crowded")
    central = posts.join(crowded, "s").groupBy("node", "n").agg(F.min("pick").alias("pick"))
    central = central.where((F.col("pick.node") != F.col("node")) & fits(F.col("pick.n"), F.col("n"), FLOOR))
    central = stage(central.select(F.col("node").alias("a"), F.col("pick.node").alias("b")), "central")
    sets = sets_of(central.select(F.col("a").alias("node")).union(central.select("b")), bodies, names, words)
    close = stage(deltas(central, sets, similarity), "deltas")
    inside = stage(in_clusters(close, sets, similarity).union(alike), "inside")
    known = stage(connected(inside), "families")
    member = close.select("node", "centre")
    centres = close.select(F.col("centre").alias("node")).distinct().join(member, "node", "left_anti")
    member = stage(member.union(centres.select("node", F.col("node").alias("centre"))), "clusters")
    grouped = stage(with_family(posts, known).join(member, "node", "left"), "placed")
    mixed = stage(grouped.groupBy("s").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi").select("s"), "mixed")
    a = stage(grouped.join(small_side(mixed), "s", "left_semi").drop("rare"), "left")
    # Both sides are one table, so that it is shuffled once.
    a = a.join(small_side(sketches), "node")
    # Nodes of one cluster have met; others may be similar if enough shingles follow the shared one and the sketches agree.
    apart = (F.col("a.family") < F.col("b.family")) & ~F.coalesce(F.col("a.centre") == F.col("b.centre"), F.lit(False))
    left = F.least(F.col("a.n") - F.col("a.place"), F.col("b.n") - F.col("b.place"))
    follow = left >= overlap_wanted(similarity, "a.n", "b.n")
    likely = fits(F.col("a.n"), F.col("b.n"), similarity) & follow & sketches_fit(similarity, "a", "b")
    pairs = a.alias("a").join(a.alias("b"), (F.col("a.s") == F.col("b.s")) & apart & likely)
    pairs = stage(pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "meeting")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = rows.join(small_side(stage(names.join(ends, "node", "left_semi"), "ends")), [*keys, "node"])
    own = stage(own.select("node", "n", "sketch").dropDuplicates(["node"]), "sketches")
    pairs = stage(promising(pairs, own, similarity), "candidates")
    sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), bodies, names, words)
    return connected(inside.union(stage(similar(pairs, sets, similarity), "verified")))


def one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """All columns of the documents that stay: of each group of near copies the row with the smallest doc_id."""
    name = row_name()
    bodies = docs.select(*name, F.col("text").cast("string").alias("body"))
    with passing_stages(docs.sparkSession) as keep:
        rows = stage(prefixes(bodies, frequent(bodies, words), words, similarity), "shingles")
        roots = near_copies(rows, bodies, words, similarity)
        members = rows.groupBy("no_id", "id", "h", "node").count().join(roots, "node", "left")
        members = keep(members.withColumn("root", F.coalesce("root", "node")), "members")
    return first_of_each(docs, members)
