"""Spelling variants: words one edit apart, found by a trie of letter-group counts.

Letters are dealt into 16 groups. A word's path in the trie is the number of
its letters in each group, one after the other; words are the leaves. One
inserted, deleted or replaced letter raises at most one count and lowers at
most one. So a search walks down with a budget of one surplus and one
deficit, spends either where it likes, and leaves a branch as soon as no word
lies below it. The words of a leaf that it reaches are verified.

The walk is a chain of joins, four groups a step: every path that has come so
far is offered the ways to go on, and those that lead to a node of the trie
stay (a semi join with the nodes of that depth, broadcast only if counted to
be few). Equal paths walk once, whatever the number of their words. Each pair
of paths is found from one side only: the longer word's, or, among words of
one length, the side that spends its surplus before its deficit.

A path is a number of 16 half bytes; a count of 16 or more wraps around, which
may offer more leaves but loses none.

Cases: a null text has no words; a null id counts as no characters before the
colon; words of any length are compared whole; equal numbers are decided by
code-point order; rows repeated with one id count each; an empty table gives
an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import small_side, text_of
from ripplemark.session import stage

LETTERS = r"A-Za-zÀ-ÿ"
#: Letters of each group but the last, which holds all others.
GROUPS = ("e", "a", "i", "o", "n", "t", "r", "s", "u", "l", "h", "d", "c", "m", "gp")
GROUPS_A_STEP = 4
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many is damaged by the checks.
DAMAGED = 31
#: What a path has spent: nothing, its surplus, or all that it may.
NOTHING, SURPLUS, DONE = 0, 1, 2


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """Every maximal run of at least ``least`` letters, A-Z lower-cased: ``doc_id, word``."""
    found = F.regexp_extract_all(text_of(text_col), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))
    each = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.explode(found).alias("run"))
    return each.select("doc_id", F.translate("run", ascii_uppercase, ascii_lowercase).alias("word"))


def damaged(words: DataFrame, one_in: int = DAMAGED) -> DataFrame:
    """The words of :func:`runs`, some without one letter, as told by the CRC-32 of ``doc_id:word``."""
    fate = F.crc32(F.concat(F.coalesce("doc_id", F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    place = (F.col("fate") % F.char_length("word")).cast("int")
    shorter = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.char_length("word")))
    return words.withColumn("fate", fate).select("doc_id", F.when(F.col("fate") % one_in == 0, shorter).otherwise(F.col("word")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words that are long and frequent enough."""
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def path_of(word: str) -> Column:
    """Letters of each group, as half bytes of one number; the first group is the highest."""
    size = F.char_length(word)
    counts = [size - F.char_length(F.translate(F.col(word), group, "")) for group in GROUPS]
    counts.append(F.char_length(F.translate(F.col(word), "".join(GROUPS), "")))
    path = F.lit(0).cast("bigint")
    for n, count in enumerate(counts):
        path = path.bitwiseOR(F.shiftleft((count % 16).cast("bigint"), 4 * (15 - n)))
    return path


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def change(group: int, by: int) -> Column:
    """The bits of ``path`` that differ if a group's count is one more or one less."""
    count = F.shiftrightunsigned("path", 4 * (15 - group)).bitwiseAND(F.lit(15).cast("bigint"))
    return F.shiftleft(count.bitwiseXOR((count + by + 16) % 16), 4 * (15 - group))


def ways(first: int) -> Column:
    """What a path may do in the groups of one step: array of ``bits`` that change and what is then ``spent``."""
    groups = range(first, first + GROUPS_A_STEP)
    way = lambda bits, spent: F.struct(bits.alias("bits"), F.lit(spent).alias("spent"))
    stay = F.lit(0).cast("bigint")
    fewer = [way(change(g, -1), DONE) for g in groups]
    more = [way(change(g, 1), SURPLUS) for g in groups]
    both = [way(change(g, 1).bitwiseXOR(change(h, -1)), DONE) for g in groups for h in groups if g < h]
    return (
        F.when(F.col("spent") == NOTHING, F.array(way(stay, NOTHING), *fewer, *more, *both))
        .when(F.col("spent") == SURPLUS, F.array(way(stay, SURPLUS), *fewer))
        .otherwise(F.array(way(stay, DONE)))
    )


def neighbours(paths: DataFrame) -> DataFrame:
    """``path, other`` for all paths of the trie that a search with the budget reaches, itself included."""
    walk = paths.select("path", F.lit(0).cast("bigint").alias("bits"), F.lit(NOTHING).alias("spent"))
    for first in range(0, len(GROUPS) + 1, GROUPS_A_STEP):
        mask = signed((1 << 64) - (1 << 4 * (16 - first - GROUPS_A_STEP)))
        nodes = paths.select(F.col("path").bitwiseAND(F.lit(mask)).alias("node")).distinct()
        nodes = small_side(stage(nodes, "nodes"))
        walk = walk.select("path", "bits", F.explode(ways(first)).alias("way"))
        walk = walk.select("path", F.col("bits").bitwiseXOR(F.col("way.bits")).alias("bits"), "way.spent")
        walk = walk.withColumn("node", F.col("path").bitwiseXOR(F.col("bits")).bitwiseAND(F.lit(mask))).join(nodes, "node", "left_semi")
    return walk.where(F.col("spent") != SURPLUS).select("path", F.col("path").bitwiseXOR(F.col("bits")).alias("other"))


def near_words(words: DataFrame, ends: int = LEAST_LENGTH // 2) -> DataFrame:
    """``word, other, n`` for every word and each of its near words, n being the other's; both directions.

    ``words``: distinct ``word`` of at least 2 x ``ends`` letters, with its
    ``n``. One edit leaves the first or the last ``ends`` letters alone,
    which is looked at before the words are compared whole.
    """
    first, last = F.substring("word", 1, ends), F.right("word", F.lit(ends))
    leaves = stage(words.select("word", "n", path_of("word").alias("path"), first.alias("first"), last.alias("last")), "leaves")
    pairs = stage(neighbours(stage(leaves.select("path").distinct(), "paths")), "reached")
    two = leaves.select(F.col("path").alias("other"), *(F.col(c).alias(f"{c}2") for c in ("word", "n", "first", "last")))
    one_side = (F.col("path") != F.col("other")) | (F.col("word") < F.col("word2"))
    ends_meet = (F.col("first") == F.col("first2")) | (F.col("last") == F.col("last2"))
    met = pairs.join(leaves, "path").join(two, "other").where(ends_meet & one_side & (F.levenshtein("word", "word2", 1) == 1))
    met = stage(met.select("word", "n", "word2", "n2"), "near")
    return met.select("word", F.col("word2").alias("other"), F.col("n2").alias("n")).union(
        met.select(F.col("word2").alias("word"), F.col("word").alias("other"), "n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where following ``word, form`` ends. A form is more frequent than its word, so there are no rings."""
    known = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        far = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = known.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = stage(jumped, "roots")
        known = jumped.select("word", "root")
        if jumped.where("moved").isEmpty():
            return known


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words with their number of occurrences ``n``.

    A word's form is its near word of largest ``n`` (ties: the first in
    code-point order) if that is at least ``ratio`` times its own.
    """
    words = stage(words, "words")
    best = F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best")
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    both = words.join(near, "word", "left")
    chosen = -F.col("best.less") >= ratio * F.col("n")
    told = stage(
        both.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"),
        ),
        "told",
    )
    found = roots(told.where("form is not null"))
    return told.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`variants` of the words of ``docs``."""
    return variants(vocabulary(runs(docs, id_col, text_col)))


def variants_report(docs: DataFrame) -> DataFrame:
    """:func:`variants` of the words of ``docs`` after planted damage."""
    return variants(vocabulary(damaged(runs(docs))))
