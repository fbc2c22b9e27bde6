"""The operators applied to whole tables: one query each, with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from calibrix.config import scratch_path
from calibrix.llm import (bpe, licenses, merkle, mixing, orc_tokens, quadratic, quality_rules, secret_scan, simhash, spelling, toxicity, warc,
                          word_runs)
from calibrix.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC archives and read back from them."""
    path = scratch_path(spark, "warc", uuid.uuid4().hex)
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.page_records(warc.read_warc(manifest, with_payload=False))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed so that a source's share of characters goes with the square root of its size."""
    return mixing.mix(table(spark, sf_dir, "documents"), copy="copy", position="position")


def op3_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written as ORC and read back from the files."""
    path = scratch_path(spark, "token_orc", uuid.uuid4().hex)
    orc_tokens.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY), END_ID)
    return orc_tokens.token_index(spark, path)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.quality(docs, quality_rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("component")


def op11_quadratic_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    statistics = quadratic.statistics_table(table(spark, sf_dir, "documents"))
    return quadratic.quality_scores(statistics, quadratic.fit_discriminant(statistics, table(spark, sf_dir, "labels")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of all documents' words; a word in 31 of those of a document has lost a letter, as the contract says."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), drop=31)


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents' runs; a tenth of the documents has a repeated tail, as the contract says."""
    return word_runs.digests(word_runs.periodic_runs(table(spark, sf_dir, "documents"), edit=word_runs.repeated_tail))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_mix_sources": op2_mix_sources,
    "op3_merkle": op3_merkle,
    "op4_token_orc": op4_token_orc,
    "op5_quality_rules": op5_quality_rules,
    "op6_secret_scan": op6_secret_scan,
    "op7_license_scan": op7_license_scan,
    "op8_bpe": op8_bpe,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
    "op11_quadratic_quality": op11_quadratic_quality,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_word_runs": op13_word_runs,
}

_UNIFORM = "('0x' || substr(md5({}), 1, 13))::BIGINT / 4503599627370496.0"

ORACLE = {
    "op2_mix_sources": f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(length(text)) AS chars FROM documents GROUP BY source HAVING sum(length(text)) > 0
), weights AS (
  SELECT source, chars, pow(chars, 0.5) AS weight FROM sizes
), rates AS (
  SELECT source, weight / (SELECT sum(weight) FROM weights) * 1.0 * (SELECT sum(chars) FROM weights)::DOUBLE / chars AS rate
  FROM weights
), split AS (
  SELECT source, ceil(rate / {mixing.STEP})::BIGINT AS parts, rate / ceil(rate / {mixing.STEP}) AS mean FROM rates WHERE rate > 0
), cdf AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS f FROM split
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), f + p * mean / (k + 1) FROM cdf WHERE k < 96
), draws AS (
  SELECT d.doc_id, d.source, {_UNIFORM.format("'42:' || d.doc_id || ':' || i")} AS u
  FROM documents d JOIN split s USING (source), unnest(range(1, s.parts + 1)) AS t(i)
), counts AS (
  SELECT w.doc_id, count(c.k) AS n FROM draws w JOIN cdf c ON c.source = w.source AND c.f <= w.u GROUP BY w.doc_id
)
SELECT d.*, copy::INTEGER AS copy, {_UNIFORM.format("'43:' || d.doc_id || ':' || copy")} AS position
FROM documents d JOIN counts USING (doc_id), unnest(range(1, n + 1)) AS t(copy)
""",
    "op7_license_scan": licenses.sql(),
}
