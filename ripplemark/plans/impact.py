"""From two revisions of a repository to ranked tests, as one staged plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.operators import configs, scoring, services, terms
from ripplemark.sources import corpus, reports
from ripplemark.session import stage


@dataclass
class ImpactRun:
    """Frames of one run; each is lazy over staged tables."""

    changes: DataFrame
    tests: DataFrame
    services: DataFrame
    idf: DataFrame
    changed_terms: DataFrame
    relevance: DataFrame
    candidate_lexical: DataFrame  # of the tests that the threshold leaves a chance
    ranked: DataFrame

    def entries(self) -> DataFrame:
        return reports.report_entries(self.changes, self.ranked)

    def summary(self) -> DataFrame:
        return reports.report_summary(self.entries(), self.tests)


def changed_terms(
    changes: DataFrame, new_configs: DataFrame, profiles: DataFrame, stop_words: terms.StopWords = None
) -> DataFrame:
    """Terms of changed source files and of the keys of changed config files."""
    sources = changes.filter(F.col("category") == "source").select("path")
    code = terms.profile_rows(profiles.join(sources, "path", "left_semi"))
    facts = configs.config_facts(new_configs)
    return terms.union_terms(code, terms.key_terms(facts, stop_words))


def analyze(
    old: DataFrame,
    new: DataFrame,
    tests: DataFrame | None = None,
    stop_words: terms.StopWords = None,
    threshold: float = scoring.RANK_THRESHOLD,
) -> ImpactRun:
    """Rank the tests a change affects.

    ``old`` and ``new`` are ``(path, content)``; ``tests`` defaults to the
    test files of ``new``. Intermediates are staged where their true size
    decides a join or where text would be read again: the change set, the
    contents of changed config files (a sliver of the corpus that four
    steps read), the affected services, and the term profiles, so the
    corpus is split into terms once.
    """
    corpus_files = corpus.corpus_files(new)
    if tests is None:
        tests = corpus.find_tests(new)
    else:
        corpus_files = corpus.with_tests(corpus_files, tests)

    changes = stage(corpus.reviewable(corpus.changed_files(old, new)), "changes")
    profiles = stage(terms.file_profiles(corpus_files, stop_words), "profiles")

    config_paths = changes.filter(F.col("category") == "config").select("path")
    both = old.select("path", "content", F.lit("old").alias("side")).unionByName(
        new.select("path", "content", F.lit("new").alias("side"))
    )
    touched_configs = stage(both.join(config_paths, "path", "left_semi"), "touched_configs")
    old_configs = touched_configs.filter("side = 'old'").select("path", "content")
    new_configs = touched_configs.filter("side = 'new'").select("path", "content")

    lines = corpus.changed_lines(old_configs, new_configs, config_paths)
    touched = stage(services.affected_services(changes, lines, new_configs), "affected")

    idf = terms.idf_of_profiles(profiles)
    wanted = changed_terms(changes, new_configs, profiles, stop_words)
    relevance = stage(scoring.service_relevance(tests, touched), "relevance")
    candidates = scoring.worth_scoring(relevance, threshold)
    distinctive = terms.distinctive_terms(wanted, idf)
    texts = profiles.join(candidates.select("path"), "path", "left_semi")
    lexical = scoring.lexical_scores(terms.profile_rows(texts), candidates, distinctive)
    ranked = stage(scoring.combined_ranking(lexical, candidates, threshold), "ranked")
    return ImpactRun(
        changes=changes,
        tests=tests.select("path"),
        services=touched,
        idf=idf,
        changed_terms=wanted,
        relevance=relevance,
        candidate_lexical=lexical,
        ranked=ranked,
    )
