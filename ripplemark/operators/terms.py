"""Terms of files: documents to term rows, corpus weights, change terms."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions import words as W
from ripplemark.session import stage


# A list of words becomes a literal of the plan; a DataFrame of ``word`` takes an anti join.
StopWords = Iterable[str] | DataFrame | None


def _exploded(rows: DataFrame, text: str, stop_words: StopWords, *kept: str) -> DataFrame:
    if not isinstance(stop_words, DataFrame):
        return rows.select(*kept, F.explode(W.terms(text, stop_words)).alias("term"))
    return W.without_stop_words(rows.select(*kept, F.explode(W.terms(text, [])).alias("term")), stop_words)


def term_rows(files: DataFrame, stop_words: StopWords = None) -> DataFrame:
    """Distinct ``(path, term)``; distinct inside each row, so no shuffle."""
    return _exploded(files, "content", stop_words, "path")


def distinct_terms(files: DataFrame, stop_words: StopWords = None) -> DataFrame:
    """Union of the term sets of many files."""
    return term_rows(files, stop_words).select("term").distinct()


def union_terms(*term_sets: DataFrame) -> DataFrame:
    """Set union of one-column term frames."""
    out = term_sets[0].select("term")
    for more in term_sets[1:]:
        out = out.union(more.select("term"))
    return out.distinct()


def common_terms(left: DataFrame, right: DataFrame) -> DataFrame:
    """Set intersection of two one-column term frames."""
    return left.select("term").intersect(right.select("term"))


def file_profiles(files: DataFrame, stop_words: StopWords = None) -> DataFrame:
    """``(path, terms array)`` of every non-empty file.

    Staged by the impact plan: texts are split into terms once, and corpus
    weights, change terms and test terms all read the much smaller table.
    """
    texts = files.filter(F.col("content") != "")
    if not isinstance(stop_words, DataFrame):
        return texts.select("path", W.terms("content", stop_words).alias("terms"))
    kept = term_rows(texts, stop_words).groupBy("path").agg(F.collect_list("term").alias("terms"))
    none = F.array().cast("array<string>")
    return texts.select("path").join(kept, "path", "left").select("path", F.coalesce("terms", none).alias("terms"))


def profile_rows(profiles: DataFrame) -> DataFrame:
    """Profiles as ``(path, term)`` rows."""
    return profiles.select("path", F.explode("terms").alias("term"))


def idf_of_profiles(profiles: DataFrame) -> DataFrame:
    """``(term, df, idf)`` with idf = ln(N / (1 + df)), N non-empty files.

    Every file also emits the empty word once, so the count of that row is
    N. The frame of counts serves both the weights and N through one
    shuffle, and map-side counting leaves one row per term and task however
    common a term is.
    """
    counts = (
        profiles.select(F.explode(F.array_append("terms", F.lit(""))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.max(F.col("term") != "").alias("is_term"))
    )
    total = counts.agg(F.max(F.when(~F.col("is_term"), F.col("df")))).scalar()
    weighted = counts.filter("is_term").select("term", "df", total.alias("n_files"))
    return weighted.select(
        "term",
        "df",
        F.when(F.col("n_files") > 1, F.log(F.col("n_files") / (1 + F.col("df"))))
        .otherwise(F.lit(1.0))
        .alias("idf"),
    )


def corpus_idf(files: DataFrame, stop_words: StopWords = None) -> DataFrame:
    """Term weights over a corpus of files."""
    return idf_of_profiles(file_profiles(files, stop_words))


def extreme_terms(idf: DataFrame, n: int = 10) -> DataFrame:
    """The n most and n least distinctive terms, ties by term."""
    top = idf.orderBy(F.desc("idf"), "term").limit(n).withColumn("side", F.lit("most distinctive"))
    bottom = idf.orderBy("idf", "term").limit(n).withColumn("side", F.lit("most common"))
    return top.unionByName(bottom).select("side", "term", "df", "idf")


def key_terms(facts: DataFrame, stop_words: StopWords = None) -> DataFrame:
    """Terms of configuration keys."""
    keys = facts.select("key").distinct()
    return _exploded(keys, "key", stop_words).distinct()


def change_terms(changes: DataFrame, stop_words: StopWords = None) -> DataFrame:
    """Terms of changed keys and of their old and new values."""
    none = F.lit("None")  # a missing value is compared and printed as None
    texts = changes.select(
        F.explode(F.array("key", F.coalesce("old_value", none), F.coalesce("new_value", none))).alias("text")
    ).distinct()
    return _exploded(texts, "text", stop_words).distinct()


def distinctive_terms(changed: DataFrame, idf: DataFrame | None, threshold: float = 1.5) -> DataFrame:
    """The changed terms a lexical score counts.

    Those above the idf threshold, or all of them when none is. Written as
    a stage table: the planner then knows its true size for the join that
    follows, and counting it costs no second run.
    """
    terms = changed.select("term").distinct()
    if idf is None:
        return stage(terms, "distinctive")
    flagged = stage(
        terms.join(idf.select("term", "idf"), "term", "left").select(
            "term", (F.coalesce("idf", F.lit(0.0)) > threshold).alias("is_distinctive")
        ),
        "distinctive",
    )
    any_distinctive = flagged.agg(F.coalesce(F.max("is_distinctive"), F.lit(False))).scalar()
    return flagged.filter(F.col("is_distinctive") | ~any_distinctive).select("term")
