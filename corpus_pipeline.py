"""Documents to tokens: identification, line dedup, near dedup, decontamination, encoding.

``STAGES`` are run in order; each stage's result is written as Parquet and
read again as the next stage's documents. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ripplemark.llm import bpe, decontamination, language_id, line_dedup, shingles
from ripplemark.llm.common import table
from ripplemark.llm.queries import tokenizer
from ripplemark.session import stage

#: Bytes of an Arrow batch and rows of a Parquet reader's. Rows of documents are long; both sides of a Python stage hold an
#: Arrow batch or two per task, and a reader's batch of texts is one array of the heap.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "1m", "spark.sql.parquet.columnarReaderBatchSize": "512"}
#: Share of its fixed sizes that a BPE worker may fill here, where executors still hold what the stages before have used.
CACHES = 1 / 3
#: Steps are tables, so what a step has shuffled is of no use once its table is written.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def in_small_batches(spark: SparkSession) -> None:
    """Sets the session's sizes of batches, unless they are set; results do not depend on them."""
    for setting, size in SMALL_BATCHES.items():
        if spark.conf.get(setting, None) is None:
            spark.conf.set(setting, size)


def without_old_shuffles(spark: SparkSession) -> None:
    """Lets the session delete shuffled files when their query is done; results do not depend on it."""
    spark.conf.set(CLEANUP_SETTING, "true")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    in_small_batches(spark)
    return language_id.accepted_documents(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; every document stays. Copies are one page: they are for the next stage."""
    return line_dedup.drop_boilerplate(docs, copies=False)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash, then the rest; five-word shingles, similarity 0.8) the smallest id stays."""
    in_small_batches(spark)
    return shingles.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    in_small_batches(spark)
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of the documents that are left, as digests."""
    in_small_batches(spark)
    return bpe.digests(docs, tokenizer(), share=CACHES)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_boilerplate),
    ("simhash_near_dedup", one_of_near_copies),
    ("decontamination", without_leaks),
    ("bpe", encoded),
]
#: Languages, fingerprints, BM25 and tokens are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    without_old_shuffles(spark)
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
