"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

1. toxicity: documents that the factorization machine rejects go.
2. simhash: one document (the smallest id) of each near-duplicate component stays.
3. secrets: secrets in the texts are replaced by ``[SECRET]``; every document stays.
4. mixing: sources are replicated by Poisson draws to shares in proportion to the square root of their size.
5. tokens: each text's BPE ids, with digests of the ids and of the decoded text.

Null texts count as empty in every stage and stay null until the last; rows with a null id are kept by the filters (null ids count as one id where
ids decide) and have no label. Repeated rows are near-duplicates, so one of them stays. Empty and very long texts are handled whole, ties as the
operators say. Further columns, whatever their names, are carried up to the last stage, which has its own columns. Without labels no document is
toxic. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from calibrix.config import scratch_path
from calibrix.llm import bpe, mixing, secret_scan, simhash, toxicity
from calibrix.llm.common import table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"),
                                with_ids=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("secret_scan", secrets_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encoding", tokens_stage),
]

# The learnt scores, the components and the token ids can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over ``documents``, each result a Parquet table that the next reads."""
    docs, run_id = table(spark, sf_dir, "documents"), uuid.uuid4().hex
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline_{name}", run_id)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
