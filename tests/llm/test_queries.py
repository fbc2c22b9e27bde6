import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import corpus_pipeline  # noqa: E402
from check_oracle import TABLES, norm  # noqa: E402
from calibrix.llm import bpe, mixing, secret_scan, simhash, toxicity  # noqa: E402
from calibrix.llm.common import table  # noqa: E402
from calibrix.llm.queries import ORACLE, QUERIES  # noqa: E402

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{D}/{t}.parquet')")
    got, exp = QUERIES[name](spark, D).toPandas(), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(exp.columns) and norm(got).equals(norm(exp))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op2_mix_sources", "op12_spelling_variants"}))
def test_one_row_per_input_row(spark, name):
    rows = table(spark, D, "pages" if name == "op1_warc" else "documents")
    key = rows.columns[0]
    got = QUERIES[name](spark, D).select(key).collect()
    assert sorted(r[0] for r in got) == sorted(r[0] for r in rows.select(key).collect())


def test_pipeline_stages(spark, tmp_path):
    """Each stage on what its predecessor kept."""
    docs = table(spark, D, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = docs.collect(), out.collect()
        if k < 4:
            assert out.columns == docs.columns
        if k == 0:
            model = toxicity.fit_toxicity(docs, table(spark, D, "labels"))
            ok = {r.doc_id for r in toxicity.toxicity(docs, model).collect() if not r.predicted}
            assert sorted(after) == sorted(r for r in before if r.doc_id in ok)
        elif k == 1:
            comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert sorted(after) == sorted(r for r in before if comp[r.doc_id] == r.doc_id)
        elif k == 2:
            assert sorted((r.doc_id, r.text) for r in after) == sorted((r.doc_id, secret_scan.redacted(r.text, "[SECRET]")) for r in before)
        elif k == 3:
            assert sorted(after) == sorted(mixing.mix(docs).collect()) and {r.doc_id for r in after} <= {r.doc_id for r in before}
        else:
            encode = bpe.encoder(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")).encode
            assert sorted((r.doc_id, r.n_tokens) for r in after) == sorted((r.doc_id, len(encode(r.text)) // 4) for r in before)
        docs = out
    assert docs.columns == ["doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_pipeline_runs_whole(spark):
    assert corpus_pipeline.run(spark, D).count() > 50


def test_pipeline_of_odd_rows_and_of_none(spark, odd_docs, no_docs, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns; a table without rows or labels."""
    labels = spark.createDataFrame([(1, 1, 1), (9, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for name, docs, known in (("odd", odd_docs, labels), ("unlabelled", odd_docs, labels.limit(0)), ("none", no_docs, labels)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        known.write.parquet(str(tmp_path / name / "labels.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        if name == "none":
            assert rows == []
        else:
            # Copies of one text (ids 1 and 2; the repeated row of 7; texts without words) leave one row each, sources are replicated.
            assert {r.doc_id for r in rows} <= {r.doc_id for r in odd_docs.collect()} and rows
            assert all(r.n_tokens == len(r.ids) for r in rows)


def test_filters_of_the_pipeline_on_odd_rows(spark, odd_docs):
    docs = simhash.drop_near_duplicates(odd_docs)
    assert docs.columns == odd_docs.columns
    texts = [(r.text or "").split() for r in docs.collect()]
    assert len(texts) == len({" ".join(t) for t in texts}) and docs.count() < odd_docs.count()
    assert {" ".join(t) for t in texts} == {" ".join((r.text or "").split()) for r in odd_docs.collect()}


def test_entry_lists_them():
    import __spark_entry__ as e

    assert {*QUERIES, "pipeline"} <= set(e.queries()) and set(ORACLE) <= set(e.oracle_sql())
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
