import zlib

import numpy as np
import pytest

from calibrix.llm import quadratic as Q
from calibrix.llm.common import table
from calibrix.llm.queries import op11_quadratic_quality

D = "/root/testdata/sf0.01"


def moments(x):
    return Q.Moments(len(x), x.sum(0), x.T @ x)


def test_log_densities_against_the_definition():
    """With no shrinkage, the difference is that of two normal log densities by the textbook formula."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, (500, 4)) @ rng.normal(0, 1, (4, 4)), rng.normal(1, 2, (300, 4))
    model = Q.discriminant((moments(a), moments(b)), 0.0, 0.0)
    x = rng.normal(0, 2, (50, 4))

    def log_density(z, of):
        m, s = of.mean(0), np.cov(of.T, bias=True)
        gap = z - m
        return -0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(s), gap) - 0.5 * np.linalg.slogdet(s)[1] + np.log(len(of) / 800)

    assert np.allclose(model.difference(x), log_density(x, b) - log_density(x, a), atol=1e-8)


@pytest.mark.parametrize("pooled,ridge", [(1.0, 0.0), (0.3, 0.1), (0.0, 1.0)])
def test_shrinkage_against_the_definition(pooled, ridge):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, (80, 3)), rng.normal(1, 3, (50, 3))
    model = Q.discriminant((moments(a), moments(b)), pooled, ridge)
    scale = np.concatenate([a, b]).std(0)
    sa, sb = (np.cov((z / scale).T, bias=True) for z in (a, b))
    within = (80 * sa + 50 * sb) / 130
    for s, w in zip((sa, sb), model.inverses, strict=True):
        s = (1 - pooled) * s + pooled * within
        s = (1 - ridge) * s + ridge * np.trace(s) / 3 * np.eye(3)
        assert np.allclose(np.linalg.inv(s), w.T @ w)


def test_statistics_of_a_text():
    got = dict(zip(Q.FEATURES, Q.transformed_statistics("Ab cd!\nAb cd!\n\n9 é é é".encode()), strict=True))
    share = lambda p: np.arcsin(np.sqrt(p))
    exp = {"words": np.log1p(8), "line_repeats": share(1 / 3), "commonest_word": share(3 / 8), "upper": share(2 / 17), "calls": share(2 / 17),
           "beyond": share(3 / 17), "distinct_words": np.log(4) / np.log(8), "words_per_line": np.log(8 / 3)}
    assert all(np.isclose(got[k], v) for k, v in exp.items())
    assert not Q.transformed_statistics(b"").any() and not Q.transformed_statistics(b" \n ").any()


def test_moments_are_those_of_all_rows(spark):
    docs = table(spark, D, "documents")
    rows = Q.statistics_table(docs).selectExpr("x", "cast(doc_id % 2 as int) as y", "cast(doc_id % 3 as int) as fold")
    got = Q.class_moments(rows.repartition(7))
    x = {(r.doc_id % 2, r.doc_id % 3): [] for r in docs.collect()}
    for r in docs.collect():
        x[r.doc_id % 2, r.doc_id % 3].append(Q.transformed_statistics(r.text.encode()))
    assert set(got) == set(x)
    for k, m in got.items():
        exp = moments(np.array(x[k]))
        assert m.n == exp.n and np.allclose(m.total, exp.total) and np.allclose(m.products, exp.products)


def test_held_out_labels(spark):
    """Labels that the fit hasn't seen; held_out by the contract's formula."""
    labels = {r.doc_id: r.quality for r in table(spark, D, "labels").collect()}
    rows = op11_quadratic_quality(spark, D).collect()
    assert len(rows) == table(spark, D, "documents").count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    seen = [(r, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(seen) > 80 and np.mean([r.predicted == y for r, y in seen]) > 0.95
    good, bad = ([r.score for r, y in seen if y == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.98


def test_held_out_labels_do_not_matter(spark):
    docs, labels = table(spark, D, "documents"), table(spark, D, "labels")
    stats = Q.statistics_table(docs)
    other = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    a, b = (Q.fit_discriminant(stats, some) for some in (labels, other))
    assert np.allclose(a.inverses, b.inverses) and np.allclose(a.means, b.means)


def test_odd_rows_and_labels(spark, odd_docs):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (6, 1), (9, 1), (7, None), (None, 0), (4, 1), (5, 7)], "doc_id long, quality int")
    stats = Q.statistics_table(odd_docs)
    got = Q.quality_scores(stats, Q.fit_discriminant(stats, labels)).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1 and not any(r.held_out for r in got if r.doc_id is None)


def test_no_model_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    stats = Q.statistics_table(odd_docs)
    assert Q.fit_discriminant(stats, labels) is None
    assert {(r.score, r.predicted) for r in Q.quality_scores(stats, None).collect()} == {(0.5, 1)}
    none = Q.statistics_table(no_docs)
    assert Q.fit_discriminant(none, labels) is None and Q.quality_scores(none, None).collect() == []
    assert Q.fit_discriminant(stats, labels.where("1 = 0")) is None
