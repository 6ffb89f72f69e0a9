"""Language of a text by Bayesian fusion of four kinds of evidence.

* text: naive Bayes over hashed byte trigrams of the lower-cased letters;
* declared language: P(declared | language), counted over the corpus;
* address suffix: P(suffix | language), counted over the corpus;
* host: a prior that is smoothed from the suffix's prior for hosts with few
  pages, which in turn is smoothed from the corpus's.

The three tables come from grouped aggregation of what the text alone says,
so a declaration counts as much as it has proved right. ``und`` (no known
language) is a class of its own with uniform trigrams. A row is accepted if
its best language is a known one and its posterior reaches a limit.

The trigram model is fitted on a bounded sample of distinct labelled texts
(about ``SAMPLE`` per language); all rows are counted in the tables. Every
label is a class of the model, which takes 256 KB for each.

Cases: a null or empty text, or one without letters, has no text evidence
and is rejected (``und``); null declarations, addresses and hosts are no
evidence; equal posteriors go to the language first by name; rows repeated
with one id give one row each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.common import kept_by_worker, small_side
from ripplemark.session import stage

#: Distinct texts of a language, about, from which its trigrams are counted.
SAMPLE = 400
BUCKETS = 1 << 16
#: Trigrams that count in full; evidence of longer texts grows no further.
ENOUGH = 60.0
ACCEPT, HOST_WEIGHT, SMOOTH = 0.5, 20.0, 1.0
UND = "und"
#: Log-odds that a text must gain before it is no known language; a few odd words are not enough.
DOUBT = 10.0


def grams(data: bytes) -> np.ndarray:
    """Hashed byte trigrams of the letters of a lower-cased text; other signs are one space."""
    raw = np.frombuffer(b" " + data + b" ", dtype=np.uint8).astype(np.uint32)
    upper = (raw >= 65) & (raw <= 90)
    raw[upper] += 32
    # Latin letters with marks: capitals of the block after 0xC3 are 32 below their small letters.
    marked = np.zeros(len(raw), dtype=bool)
    marked[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    raw[marked] += 32
    letter = (raw >= 97) & (raw <= 122) | (raw >= 128)
    raw[~letter] = 32
    keep = np.ones(len(raw), dtype=bool)
    keep[1:] = letter[1:] | letter[:-1]
    raw = raw[keep]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    mixed = (raw[:-2] * 0x9E3779B1 + raw[1:-1] * 0x85EBCA6B + raw[2:] * 0xC2B2AE35).astype(np.uint32)
    return ((mixed ^ (mixed >> np.uint32(15))) % BUCKETS).astype(np.int64)


def gram_counts(rows: DataFrame) -> DataFrame:
    """``lang, gram, n`` of the rows' ``lang, body``, summed within each task first."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                at = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                at += np.bincount(grams(text.as_py() or b""), minlength=BUCKETS)
        for lang, counts in sums.items():
            seen = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(counts[seen])], ["lang", "gram", "n"])

    part = rows.select("lang", "body").mapInArrow(count, "lang string, gram bigint, n bigint")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages by name and their log-probabilities of a trigram.

    The sample takes texts by a hash, at a share per language that makes
    about ``sample`` distinct ones; copies of a text count once.
    """
    rows = labelled.select(F.lower(F.col(lang_col).cast("string")).alias("lang"), F.col(text_col).cast("string").alias("body"))
    rows = rows.where("lang is not null and body is not null").withColumn("h", F.xxhash64(F.lit("fit"), "body"))
    sizes = stage(rows.select("lang", "h").distinct().groupBy("lang").count(), "sizes")
    names = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not names:
        return [], np.zeros((BUCKETS, 0), dtype=np.float32)
    # Not made from Python rows: that would start Python workers of another kind on the executors, which stay beside ours.
    shares = sizes.select("lang", (F.lit(float(sample)) / F.col("count")).alias("share"))
    picked = rows.join(F.broadcast(shares), "lang").where((F.col("h") / F.lit(2.0**64) + 0.5) < F.col("share"))
    picked = picked.select("lang", "h", "body").dropDuplicates(["lang", "h"])
    column = {lang: n for n, lang in enumerate(names)}
    counts = np.full((BUCKETS, len(names)), 0.05)
    for lang, gram, n in gram_counts(picked).toLocalIterator():
        counts[gram, column[lang]] += n
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def evidence(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The rows with ``likelihood``: per class (``und`` first) the tempered log-likelihood of ``body``; null without letters."""
    names, table = model
    shared = rows.sparkSession.sparkContext.broadcast(table.tobytes())
    kinds, mark, bucket_bits = len(names), str(hash(table.tobytes())), -np.log(BUCKETS)
    kept = [c for c in rows.columns if c != "body"]

    def read(batches):
        logs = kept_by_worker("trigrams", mark, lambda: np.frombuffer(shared.value, dtype=np.float32).reshape(BUCKETS, kinds))
        for batch in batches:
            out = []
            for text in batch.column("body").cast(pa.large_binary()):
                found = grams(text.as_py() or b"")
                if not len(found):
                    out.append(None)
                    continue
                sums = np.zeros(kinds)
                for at in range(0, len(found), 1 << 16):
                    sums += logs[found[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
                temper = min(1.0, ENOUGH / len(found))
                out.append([len(found) * bucket_bits * temper - DOUBT, *(sums * temper)])
            columns = [batch.column(c) for c in kept] + [pa.array(out, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "likelihood"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "body")
    return rows.select(*kept, "body").mapInArrow(read, f"{schema}, likelihood array<double>")


def normal(logs: Column) -> Column:
    """Probabilities from logs."""
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def suffix_of(address: Column) -> Column:
    """Last label of a host name, for names of two labels or more."""
    return F.lower(F.regexp_extract(address, r"\.([A-Za-z][A-Za-z0-9-]*)$", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)", 1))


def markup_language(html: Column) -> Column:
    """The language that a page's markup declares: of the html element, else of a meta element."""
    tag = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    meta = F.regexp_extract(html, r"(?i)<meta\b[^>]*?content-language[\"']?[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return F.lower(F.when(tag != "", tag).when(meta != "", meta))


def counted(rows: DataFrame, key: str, classes: int) -> DataFrame:
    """Sum of the text's posteriors per value of ``key``, as an array ``mass``."""
    sums = rows.where(F.col(key).isNotNull() & F.col("posterior").isNotNull()).groupBy(key).agg(*[F.sum(F.col("posterior")[n]).alias(f"m{n}") for n in range(classes)])
    return sums.select(key, F.array(*[f"m{n}" for n in range(classes)]).alias("mass"))


def total(mass: Column) -> Column:
    return F.aggregate(mass, F.lit(0.0), lambda a, x: a + x)


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], accept: float = ACCEPT) -> DataFrame:
    """The rows without ``body`` and with ``language, posterior, accepted``.

    ``rows`` has ``body``, ``declared``, ``host`` and any columns to carry.
    """
    names = [UND, *model[0]]
    n = len(names)
    suffix = suffix_of(F.col("host"))
    read = rows.withColumns({"declared": F.lower(F.regexp_extract("declared", "^([A-Za-z]{2,3})", 1)), "suffix": suffix, "host": F.lower("host")})
    read = read.withColumns({c: F.when(F.col(c) != "", F.col(c)) for c in ("declared", "suffix", "host")})
    seen = stage(evidence(read, model), "evidence").withColumn("posterior", normal(F.col("likelihood")))
    whole = seen.where("posterior is not null").agg(*[F.coalesce(F.sum(F.col("posterior")[k]), F.lit(0.0)).alias(f"m{k}") for k in range(n)]).first()
    size = sum(whole)
    corpus = [(m + SMOOTH) / (size + n * SMOOTH) for m in whole]
    base = F.array(*map(F.lit, corpus))
    shrunk = lambda mass, above: F.zip_with(mass, above, lambda m, p: (m + HOST_WEIGHT * p) / (total(mass) + HOST_WEIGHT))
    # P(value | language) over P(value): what a value says beyond how common it is.
    said = lambda mass: F.zip_with(shrunk(mass, base), base, lambda p, q: F.log(p / q))
    declared = stage(counted(seen, "declared", n).select("declared", said(F.col("mass")).alias("by_declared")), "declared")
    suffixes = stage(counted(seen, "suffix", n).select("suffix", shrunk(F.col("mass"), base).alias("suffix_prior")), "suffixes")
    hosts = counted(seen, "host", n).withColumn("suffix", suffix_of(F.col("host")))
    hosts = hosts.join(suffixes, "suffix", "left").select("host", shrunk(F.col("mass"), F.coalesce("suffix_prior", base)).alias("host_prior"))
    hosts = stage(hosts, "hosts")
    fused = seen.join(declared, "declared", "left").join(suffixes, "suffix", "left").join(hosts, "host", "left")
    zero = F.array_repeat(F.lit(0.0), n)
    prior = F.transform(F.coalesce("host_prior", "suffix_prior", base), lambda p: F.log(p))
    logs = F.zip_with(F.zip_with("likelihood", prior, lambda a, b: a + b), F.coalesce("by_declared", zero), lambda a, b: a + b)
    done = fused.withColumn("fused", F.array_max(F.transform(normal(logs), lambda p, k: F.struct(p.alias("p"), (-k).alias("k")))))
    language = F.when(F.col("likelihood").isNull(), UND).otherwise(F.element_at(F.array(*map(F.lit, names)), 1 - F.col("fused.k")))
    kept = [c for c in rows.columns if c not in ("body", "declared", "host")]
    done = done.select(*kept, language.alias("language"), F.when(F.col("likelihood").isNull(), 0.0).otherwise(F.round("fused.p", 4)).alias("certainty"))
    return done.select(*kept, "language", F.col("certainty").alias("posterior"), ((F.col("language") != UND) & (F.col("certainty") >= accept)).alias("accepted"))


def document_rows(docs: DataFrame, *carried: Column, text_col: str = "text", lang_col: str = "lang", host_col: str = "source") -> DataFrame:
    return docs.select(*carried, F.col(text_col).cast("string").alias("body"), F.col(lang_col).cast("string").alias("declared"), F.col(host_col).cast("string").alias("host"))


def identify_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, language, posterior, accepted``: the document's declared language and source are its declaration and host."""
    return identify(document_rows(docs, F.col(id_col).alias("doc_id")), fit(docs))


def identify_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """``page_id, url, language, posterior, accepted``: the markup's declaration, the address's suffix and host beside the text."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    rows = pages.select("page_id", "url", bare.alias("body"), markup_language(F.col("html")).alias("declared"), host_of(F.col("url")).alias("host"))
    return identify(rows, fit(docs))


def accepted_documents(docs: DataFrame) -> DataFrame:
    """All columns of the documents whose language is known.

    Rows with equal text, declaration and host are decided alike, so the
    rejected rows are named by a hash of these; texts move only if there are
    too many rejected ones to broadcast.
    """
    facts = [F.col(c).cast("string") for c in ("text", "lang", "source")]
    marks = [F.xxhash64(F.lit(k), *[F.coalesce(f, F.lit("\x00")) for f in facts]) for k in (1, 2)]
    rows = document_rows(docs, marks[0].alias("h"), marks[1].alias("g"))
    rejected = stage(identify(rows, fit(docs)).where("not accepted").select("h", "g").distinct(), "rejected")
    rest = docs.select(F.struct("*").alias("row"), marks[0].alias("h"), marks[1].alias("g")).join(small_side(rejected), ["h", "g"], "left_anti")
    return rest.select("row.*")
