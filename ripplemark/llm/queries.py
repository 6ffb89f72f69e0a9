"""One query per operator over its whole table, with production parameters, and DuckDB twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ripplemark.llm import (
    bpe, conversations, decontamination, exact_dedup, fingerprints, html_extract, language_id, licenses, line_dedup, pii,
    secrets, simhash, spelling,
)
from ripplemark.llm.common import table

#: The tokenizer of the checks, and the key of the surrogates; both are parameters of their operators.
TOKENIZER = "byte_bpe_50k.json"
PII_KEY = "ripplemark-checks"


def tokenizer() -> str:
    return bpe.tokenizer_source(public_tokenizers.path(TOKENIZER))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer())


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"), PII_KEY)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_paragraphs(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.with_hex(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants_report(table(spark, sf_dir, "documents"))


def op12_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, page_languages, op2_html_extraction, op3_bpe, op4_pii_surrogates, op5_license_scan,
        op6_exact_dedup, op7_line_dedup, op8_simhash, op9_decontamination, op10_secret_scan, op11_spelling_variants,
        op12_syncmer_fingerprints, op13_conversation_repair,
    )
}

ORACLE: dict[str, str] = {
    "op6_exact_dedup": """
select doc_id, coalesce(max(doc_id) over w, doc_id) as keep_id, count(*) over w as group_size,
  doc_id is not distinct from max(doc_id) over w as kept, sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
""",
    "op7_line_dedup": """
with d as (select row_number() over () as rid, doc_id, source, text from documents),
l as (select rid, source, n, line, trim(line, ' ' || chr(9) || chr(13)) as key
      from (select rid, source, unnest(parts) as line, generate_subscripts(parts, 1) as n
            from (select rid, source, string_split(coalesce(text, ''), chr(10)) as parts from d))),
p as (select source, key, count(distinct rid) as pages from l where key <> '' group by source, key),
t as (select source, count(*) as total from d group by source),
x as (select p.source, p.key from p join t on p.source is not distinct from t.source
      where pages >= 3 and pages > total * 0.05::double),
k as (select l.rid, count(*) as n_lines, string_agg(line, chr(10) order by n) filter (x.key is null) as body
      from l left join x on l.source is not distinct from x.source and l.key = x.key group by l.rid)
select d.doc_id, case when d.text is not null then coalesce(k.body, '') end as text, k.n_lines,
  sha256(case when d.text is not null then coalesce(k.body, '') else '' end) as text_sha256
from d join k on d.rid = k.rid
""",
}
