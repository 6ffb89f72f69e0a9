"""File corpora: scanning them, comparing two revisions, the lines that differ.

A corpus is a DataFrame ``(path string, content string)`` with one row per
path; two revisions of a repository are two such frames.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from ripplemark.functions import paths as P
from ripplemark.functions.linediff import kept
from ripplemark.operators.folds import positions
from ripplemark.session import stage

# Lines of one frame that a Python task hands over.
LINES_AT_ONCE = 10_000
# Share of its lines, by length, that a renamed file keeps at least.
SIMILAR = 0.5


def scan_files(
    spark: SparkSession, root: str, glob: str | None = None, listing: DataFrame | None = None, skip: bool = False
) -> DataFrame:
    """Whole files below ``root`` as text; undecodable bytes read as ''.

    With ``skip``, files in directories that corpus and test scans leave out
    are not opened: the test is on the file's own path, which prunes files
    before they are read. Files that cannot be opened are passed over by the
    scan; a ``listing`` brings them back with '' as their content.

    Spark's file scan leaves out files of zero bytes. A ``listing`` of
    relative paths, such as a repository's index or a store's inventory,
    adds every path the scan did not return, with '' as its content.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    clean_root = root.rstrip("/")
    # the scheme and authority Spark puts in front of a plain root
    prefix = "^(?:[a-z0-9+]+:(?://[^/]*)?)?/*\\Q" + clean_root.lstrip("/") + "\\E/"
    text = F.try_validate_utf8(F.col("content").cast("string"))
    loaded = reader.load(clean_root)
    if skip:
        encoded = F.regexp_replace(F.col("_metadata.file_path"), "\\+", "%2B")
        loaded = loaded.filter(~P.is_skipped_by_scan(F.regexp_replace(F.url_decode(encoded), prefix, "")))
    scanned = loaded.select(
        F.regexp_replace("path", prefix, "").alias("path"),
        F.coalesce(text, F.lit("")).alias("content"),
    )
    if listing is None:
        return scanned
    unread = listing.select("path").distinct().join(scanned.select("path"), "path", "left_anti")
    return scanned.unionByName(unread.withColumn("content", F.lit("")))


def corpus_files(files: DataFrame) -> DataFrame:
    """Source files outside skipped directories."""
    return files.filter(P.in_corpus("path"))


def find_tests(files: DataFrame) -> DataFrame:
    """Test files of a corpus."""
    return corpus_files(files).filter(P.is_test_file("path"))


def with_tests(corpus: DataFrame, tests: DataFrame) -> DataFrame:
    """Corpus plus the tests whose path it does not hold yet."""
    missing = tests.join(corpus.select("path"), "path", "left_anti")
    return corpus.unionByName(missing.select(*corpus.columns))


def _digests(files: DataFrame) -> DataFrame:
    return files.select("path", F.unhex(F.sha2("content", 256)).alias("digest"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths added or modified in ``new``, as ``(path, change_kind)``.

    Contents are reduced to digests inside the scan, so only paths and 32
    bytes per file are shuffled. Deleted files are not listed.
    """
    before = _digests(old).withColumnRenamed("digest", "old_digest")
    return (
        _digests(new)
        .join(before, "path", "left")
        .filter(~F.col("digest").eqNullSafe(F.col("old_digest")))
        .select("path", F.when(F.col("old_digest").isNull(), "added").otherwise("modified").alias("change_kind"))
    )


def _moved(gone: DataFrame, come: DataFrame) -> DataFrame:
    """Files of equal content, the n-th vanished path with the n-th new one in path order: ``(path, old_path)``.

    Ranks are taken in ranges of (digest, path), so thousands of equal files, such as empty ones, are many tasks' work.
    """
    after, before = (
        positions(side.select("digest", F.col("path").alias("seq")), "digest").select("digest", "pos", F.col("seq").alias(name))
        for side, name in ((come, "path"), (gone, "old_path"))
    )
    return after.join(before, ["digest", "pos"]).select("path", "old_path")


def _weighed_lines(files: DataFrame, name: str) -> DataFrame:
    """Distinct lines of each file with their copies; a line counts by its characters and its end."""
    total = F.length("content") + 1
    lines = files.select(F.col("path").alias(name), total.alias(f"{name}_total"), F.explode(F.split("content", "\n")).alias("line"))
    key = F.xxhash64("line").alias("line"), (F.length("line") + 1).alias("size")
    return lines.groupBy(name, f"{name}_total", *key).agg(F.count("*").alias(f"{name}_copies"))


def _leading_lines(lines: DataFrame, counts: DataFrame, name: str, least: float) -> DataFrame:
    """The rarest lines of each file, without a tail of common ones that weighs less than ``least`` of it.

    Two files that share ``least`` of the longer one share a line that leads in both.
    """
    rest = Wd.partitionBy(name).orderBy("files", "line", "size").rowsBetween(0, Wd.unboundedFollowing)
    return (
        lines.join(counts, ["line", "size"])
        .withColumn("rest", F.sum(F.col(f"{name}_copies") * F.col("size")).over(rest))
        .filter(F.col("rest") >= F.col(f"{name}_total") * least)
        .select("line", "size", name, f"{name}_total")
    )


def _unique_names(files: DataFrame, name: str) -> DataFrame:
    """Paths by file name, for names that occur once."""
    named = files.groupBy(F.substring_index("path", "/", -1).alias("name"))
    return named.agg(F.min("path").alias(name), F.count("*").alias("n")).filter("n = 1").drop("n")


def _similar(pairs: DataFrame, after: DataFrame, before: DataFrame, least: float) -> DataFrame:
    """The pairs that share ``least`` of the longer file, with that share."""
    longer = F.greatest("path_total", "old_path_total")
    shared = F.sum(F.least("path_copies", "old_path_copies") * F.col("size"))
    return (
        pairs.join(after, "path")
        .join(before, ["old_path", "line", "size"])
        .groupBy("path", "old_path", longer.alias("longer"))
        .agg(shared.alias("shared"))
        .select("path", "old_path", (F.col("shared") / F.col("longer")).alias("share"))
        .filter(F.col("share") >= least)
    )


def _edited_moves(gone: DataFrame, come: DataFrame, least: float) -> DataFrame:
    """Files that moved and changed: those of one name first, then each other's most similar."""
    after, before = stage(_weighed_lines(come, "path"), "lines"), stage(_weighed_lines(gone, "old_path"), "lines")
    namesakes = _unique_names(come, "path").join(_unique_names(gone, "old_path"), "name").select("path", "old_path")
    named = stage(_similar(namesakes, after, before, least).select("path", "old_path"), "namesakes")

    after, before = after.join(named, "path", "left_anti"), before.join(named, "old_path", "left_anti")
    key = ["line", "size"]
    counts = after.select(*key).unionByName(before.select(*key)).groupBy(*key).agg(F.count("*").alias("files"))
    leading = _leading_lines(after, counts, "path", least).join(_leading_lines(before, counts, "old_path", least), key)
    fits = F.least("path_total", "old_path_total") >= F.greatest("path_total", "old_path_total") * least
    pairs = leading.filter(fits).select("path", "old_path").distinct()
    similar = stage(_similar(pairs, after, before, least), "similar")
    best = similar.groupBy("path").agg(F.min(F.struct(-F.col("share"), "old_path")).alias("best"))
    best_old = similar.groupBy("old_path").agg(F.min(F.struct(-F.col("share"), "path")).alias("best"))
    mutual = best.select("path", "best.old_path").join(best_old.select("old_path", "best.path"), ["path", "old_path"])
    return named.unionByName(mutual)


def change_set(old: DataFrame, new: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Added, modified and renamed files: ``(path, change_kind, old_path)``, the last NULL unless renamed.

    A new path is renamed from a vanished one in three steps, each among the
    files that the earlier ones left, and each path is used once:

    1. equal contents, paired in path order;
    2. equal file names that occur once on either side, if the files share ``least`` of the longer one;
    3. files that share that much, each the other's most similar (ties: the smaller path).

    The share is that of equal lines, copies counted, by characters. Only
    vanished and new files are compared line by line, and only pairs that
    share one of the lines rare enough to lead in both; files of mere common
    lines meet by their names or all of their kind.
    """
    after, before = _digests(new), _digests(old)
    come = stage(after.join(before.select("path"), "path", "left_anti"), "come")
    gone = stage(before.join(after.select("path"), "path", "left_anti"), "gone")
    moved = stage(_moved(gone, come), "moved")
    left = stage(come.join(moved, "path", "left_anti").select("path"), "left")
    lost = stage(gone.join(moved, gone["path"] == moved["old_path"], "left_anti").select("path"), "lost")
    edited = _edited_moves(old.join(lost, "path", "left_semi"), new.join(left, "path", "left_semi"), least)
    renames = stage(moved.unionByName(edited), "renames")
    kind = F.when(F.col("old_path").isNotNull(), "renamed").otherwise(F.col("change_kind"))
    return changed_files(old, new).join(renames, "path", "left").select("path", kind.alias("change_kind"), "old_path")


def reviewable(changes: DataFrame) -> DataFrame:
    """Changes without generated artifacts, with their category."""
    return changes.filter(~P.is_artifact("path")).withColumn("category", P.category("path"))


def _lines(content: str | None) -> list[tuple[str, bool]]:
    """Lines, each with whether a line feed ends it: a last line with and one without differ."""
    if not content:
        return []
    *ended, last = content.split("\n")
    return [(line, True) for line in ended] + ([(last, False)] if last else [])


def _line_changes(old: str | None, new: str | None) -> Counter[tuple[str, str]]:
    """(side, line) -> copies, by a diff of two texts."""
    before, after = _lines(old), _lines(new)
    found: Counter[tuple[str, str]] = Counter()
    stay, come = kept(before, after)
    found.update(("-", line) for (line, _), same in zip(before, stay) if not same)
    found.update(("+", line) for (line, _), same in zip(after, come) if not same)
    return found


def _diff_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = (
        (path, side, line, n)
        for batch in batches
        for path, old, new in zip(batch["path"], batch["old"], batch["new"])
        for (side, line), n in _line_changes(old, new).items()
    )
    while part := list(islice(rows, LINES_AT_ONCE)):
        yield pd.DataFrame(part, columns=["path", "side", "line", "copies"])


def changed_lines(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """Added (+) and removed (-) lines of changed files: ``(path, side, line, copies)``.

    A least diff of the two texts in order: a line that only moved is removed in
    one place and added in another, and a last line changes with its line
    feed. ``changes`` holds each path once; staged, it is broadcast when
    small, and contents of unchanged files never leave their scan. The two
    texts of one file meet in one row.
    """
    only = changes.select("path")
    before, after = (
        files.join(only, "path", "left_semi").select("path", F.col("content").alias(name))
        for files, name in ((old, "old"), (new, "new"))
    )
    both = after.join(before, "path", "full_outer").select("path", "old", "new")
    return both.mapInPandas(_diff_batches, "path string, side string, line string, copies bigint")


def save_bucketed(files: DataFrame, table: str, buckets: int) -> DataFrame:
    """Save a corpus as a table bucketed by path and return it.

    Joins on path between corpora saved with the same number of buckets,
    revisions or staged results, then move no content over the network.
    """
    (
        files.select("path", "content")
        .write.mode("overwrite")
        .bucketBy(buckets, "path")
        .sortBy("path")
        .saveAsTable(table)
    )
    return files.sparkSession.table(table)
