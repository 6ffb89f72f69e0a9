"""Relevance of tests: lexical overlap, service reference, names, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions import paths as P
from ripplemark.session import stage

# ---- fixed values: weights and scores of the relevance model ----
LEXICAL_WEIGHT = 0.3
SERVICE_WEIGHT = 0.7
RANK_THRESHOLD = 0.55
NAME_SCORE = 1.0
SERVICE_DIR_SCORE = 0.95
PLAIN_DIR_SCORE = 0.9
ROOT_WORD_SCORE = 0.7
IMPORT_SCORE = 0.4
URL_SCORE = 0.3
MIN_ROOT_LENGTH = 5
NAME_BONUS = 0.3
BONUS_STRIPPED = ["_service", "service", "_test", "test", "_spec", "spec"]
IMPORT_KEYWORDS = ["import", "from"]
# ---- end of fixed values ----

WORD_CHAR = "[\\p{L}\\p{N}_]"
IMPORT_RE = f"(?<!{WORD_CHAR})(?:{'|'.join(IMPORT_KEYWORDS)})\\s+"


def lexical_scores(test_terms: DataFrame, tests: DataFrame, distinctive: DataFrame) -> DataFrame:
    """Share of the distinctive terms each test holds: ``(path, lexical)``.

    ``test_terms`` is (path, term) without duplicates, ``distinctive`` one
    column of unique terms. No hint is given: a small distinctive table is
    broadcast on its measured size; otherwise the join shuffles by term, and
    a term most tests share is a skewed partition that adaptive execution
    splits, since the count below is on another key.
    """
    total = distinctive.agg(F.count("*")).scalar()
    hits = (
        test_terms.join(distinctive.select("term"), "term", "left_semi")
        .groupBy("path")
        .agg(F.count("*").alias("hits"))
    )
    return tests.select("path").join(hits, "path", "left").select(
        "path",
        F.coalesce(F.try_divide(F.coalesce("hits", F.lit(0)), total), F.lit(0.0)).alias("lexical"),
    )


def rank_lexical(scores: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Tests at or above the threshold, best first."""
    return scores.filter(F.col("lexical") >= threshold).orderBy(F.desc("lexical"), "path")


def _cuts(text: str, delimiter: str) -> Column:
    """1-based positions of the characters of a delimiter class."""
    positions = F.sequence(F.lit(1), F.length(text))
    return F.when(
        F.length(text) > 0,
        F.filter(positions, lambda i: F.substring(F.col(text), i, F.lit(1)).rlike(delimiter)),
    )


def _between_cuts(text: str, cuts: str) -> Column:
    """All substrings that start and end at a cut or at an end of the text.

    File names hold at most 255 characters, so the array is bounded.
    """
    starts = F.concat(F.array(F.lit(1)), F.transform(cuts, lambda i: i + 1))
    ends = F.concat(F.col(cuts), F.array(F.length(text) + 1))
    spans = F.flatten(
        F.transform(
            starts,
            lambda s: F.transform(
                F.filter(ends, lambda e: e > s), lambda e: F.substring(F.col(text), s, e - s)
            ),
        )
    )
    return F.coalesce(F.array_distinct(spans), F.array().cast("array<string>"))


def _prefixes_at_word_ends(run: Column) -> Column:
    """Prefixes of a run that end where a word boundary lies."""

    def is_word(i: Column) -> Column:
        return F.substring(run, i, F.lit(1)).rlike(WORD_CHAR)

    ends = F.filter(F.sequence(F.lit(1), F.length(run)), lambda i: is_word(i) != is_word(i + 1))
    return F.transform(ends, lambda i: F.substring(run, F.lit(1), i))


def _evidence(tests: DataFrame, services: DataFrame) -> DataFrame:
    """One row per (test, string a service could equal), with rule and score.

    Lower ``rule`` wins; within the path rule the first segment wins, which
    ``place`` orders. Only short strings leave the scan, not the content:
    nothing longer than the longest service name can match.
    """
    longest = services.agg(F.coalesce(F.max(F.length("service")), F.lit(0))).scalar()
    spaced = services.agg(F.coalesce(F.max(F.col("service").rlike("\\s")), F.lit(False))).scalar()
    base = tests.select(
        "path",
        F.lower(P.stem("path")).alias("stem"),
        F.filter(F.split(F.lower("path"), "/"), lambda p: p != "").alias("parts"),
        F.lower("content").alias("text"),
        longest.alias("longest"),
        spaced.alias("spaced"),
    )
    # The lookahead leaves what follows unconsumed: "from import x" has two hits.
    ahead = F.concat(
        F.lit(IMPORT_RE + "(?=(\\S(?s:.{0,"), F.col("longest").cast("string"), F.lit("})))")
    )
    pieces = F.split("text", "/")
    base = base.select(
        "path",
        "stem",
        "parts",
        "longest",
        _cuts("stem", "[_\\-.]").alias("cuts"),
        F.array_distinct(
            F.transform(
                F.regexp_extract_all("text", ahead, F.lit(1)),
                lambda r: F.when(F.col("spaced"), r).otherwise(F.regexp_extract(r, "^\\S+", 0)),
            )
        ).alias("runs"),
        F.filter(
            F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0))),
            lambda p: (p != "") & (F.length(p) <= F.col("longest") + F.length(F.lit("-service"))),
        ).alias("between"),
    ).select(
        "path",
        "parts",
        _between_cuts("stem", "cuts").alias("names"),
        F.array_distinct(F.flatten(F.transform("runs", _prefixes_at_word_ends))).alias("imported"),
        F.array_distinct(
            F.concat("between", F.transform("between", lambda p: F.regexp_replace(p, "-service$", "")))
        ).alias("urls"),
    )

    def entry(word: Column, kind: str, rule: int, place: Column, score: float) -> Column:
        return F.struct(
            word.alias("word"),
            F.lit(kind).alias("kind"),
            F.lit(rule).alias("rule"),
            place.alias("place"),
            F.lit(score).alias("score"),
        )

    def rows(words: str, kind: str, rule: int, score: float) -> Column:
        return F.transform(words, lambda w: entry(w, kind, rule, F.lit(0), score))

    placed = F.transform("parts", lambda p, i: F.struct(p.alias("part"), i.alias("place")))
    service_dirs = F.transform(
        F.filter(placed, lambda s: s.part.rlike("[-_]service$")),
        lambda s: entry(
            F.regexp_replace(s.part, "[-_]service$", ""), "service", 2, s.place, SERVICE_DIR_SCORE
        ),
    )
    plain_dirs = F.transform(placed, lambda s: entry(s.part, "service", 2, s.place, PLAIN_DIR_SCORE))
    found = F.concat(
        rows("names", "service", 1, NAME_SCORE),
        service_dirs,
        plain_dirs,
        rows("names", "root", 3, ROOT_WORD_SCORE),
        rows("imported", "service", 4, IMPORT_SCORE),
        rows("urls", "service", 5, URL_SCORE),
    )
    return base.select("path", F.inline(found)).filter("word <> ''")


def service_relevance(tests: DataFrame, services: DataFrame) -> DataFrame:
    """Best relevance of each test over the affected services: ``(path, service_score)``.

    Written as an equality join: a test emits every string a service could
    equal under the five rules, a service emits its name and, when long
    enough, its root word. The services are staged: three consumers need
    them, and the planner broadcasts them only if their bytes allow it.
    """
    named = stage(
        services.select(F.lower("service").alias("service")).filter("service <> ''").distinct(), "services"
    )
    root = F.regexp_replace(F.replace("service", F.lit("service"), F.lit("")), "^[-_]+|[-_]+$", "")
    probes = named.select(
        "service",
        F.inline(
            F.array(
                F.struct(F.lit("service").alias("kind"), F.col("service").alias("word")),
                F.struct(F.lit("root").alias("kind"), root.alias("word")),
            )
        ),
    ).filter((F.col("kind") == "service") | (F.length("word") >= MIN_ROOT_LENGTH))
    first_rule = F.min(F.struct("rule", "place", "score"))
    best = (
        _evidence(tests, named)
        .join(probes, ["kind", "word"])
        .groupBy("path", "service")
        .agg(first_rule.alias("hit"))
        .groupBy("path")
        .agg(F.max("hit.score").alias("service_score"))
    )
    return tests.select("path").join(best, "path", "left").select(
        "path", F.coalesce("service_score", F.lit(0.0)).alias("service_score")
    )


def _bonus_name(path: str) -> Column:
    name = F.lower(P.stem(path))
    for part in BONUS_STRIPPED:
        name = F.replace(name, F.lit(part), F.lit(""))
    return name


def filename_bonus(changed: DataFrame, tests: DataFrame) -> DataFrame:
    """0.3 for tests whose reduced name contains that of a changed file.

    Containment becomes equality: each distinct test name emits its
    substrings, of only those lengths changed names have (file names are at
    most 255 characters, which bounds both).
    """
    names = stage(
        changed.select(_bonus_name("path").alias("word")).filter("word <> ''").distinct(), "changed_names"
    )
    lengths = names.agg(F.coalesce(F.collect_set(F.length("word")), F.array().cast("array<int>"))).scalar()
    named_tests = tests.select("path", _bonus_name("path").alias("name"))
    parts = F.flatten(
        F.transform(
            F.filter(F.col("lengths"), lambda n: n <= F.length("name")),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.length("name") - n + 1), lambda i: F.substring(F.col("name"), i, n)
            ),
        )
    )
    matched = (
        named_tests.select("name").distinct()
        .select("name", lengths.alias("lengths"))
        .select("name", F.explode(F.array_distinct(parts)).alias("word"))
        .join(names, "word", "left_semi")
        .select("name").distinct()
        .withColumn("hit", F.lit(True))
    )
    return named_tests.join(matched, "name", "left").select(
        "path", F.when(F.col("hit"), NAME_BONUS).otherwise(0.0).alias("bonus")
    )


def worth_scoring(relevance: DataFrame, threshold: float = RANK_THRESHOLD) -> DataFrame:
    """Tests the threshold leaves a chance.

    The lexical part adds at most its weight, so a service score below
    (threshold - 0.3) / 0.7 can never rank; dropping those first spares the
    large term join and changes no result at the same threshold.
    """
    floor = (threshold - LEXICAL_WEIGHT) / SERVICE_WEIGHT
    return relevance.filter(F.col("service_score") >= floor - 1e-9)


def combined_ranking(lexical: DataFrame, relevance: DataFrame, threshold: float = RANK_THRESHOLD) -> DataFrame:
    """0.3 lexical + 0.7 service, kept at the threshold; see :func:`best_first` for an order.

    The unrounded sum meets the threshold; the score shown has six digits.
    """
    score = LEXICAL_WEIGHT * F.col("lexical") + SERVICE_WEIGHT * F.col("service_score")
    kept = relevance.join(lexical, "path").withColumn("score", score)
    kept = kept.filter((F.col("score") > 0) & (F.col("score") >= threshold))
    return kept.select("path", "lexical", "service_score", F.round("score", 6).alias("score"))


def best_first(ranked: DataFrame) -> DataFrame:
    """A ranking in its order, ties by path."""
    return ranked.orderBy(F.desc("score"), "path")
