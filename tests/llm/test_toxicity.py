import zlib

import numpy as np
import pytest

from calibrix.llm import toxicity as x
from calibrix.llm.common import table


@pytest.mark.parametrize("d", ["/root/testdata/sf0.1"])
def test_held_out_accuracy(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = x.toxicity(docs, x.fit_toxicity(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    wrong = [(r.predicted, r.toxic) for r in rows if r.predicted != r.toxic]
    positives = sum(r.toxic for r in rows)
    assert len(wrong) < 0.03 * len(rows) and sum(p for p, _ in wrong) <= 2 and sum(r.predicted for r in rows) > 0.8 * positives
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)


def test_pairs_that_linear_weights_miss():
    rng = np.random.default_rng(0)
    docs, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.4  # toxic only where both are
        docs.append(np.array([0] * int(a) + [1] * int(b) + sorted(rng.choice(np.arange(2, 40), 5, replace=False).tolist()), np.int64))
        y.append(int(a and b))
    y = np.array(y)
    m = x.fit(docs[:2000], y[:2000], epochs=15)
    rows = [np.array([m.index[int(t)] for t in d if int(t) in m.index], np.int64) for d in docs[2000:]]
    assert ((m.scores(rows) >= 0.5) == y[2000:]).mean() > 0.99
    v = m.factors
    assert v[m.index[0]] @ v[m.index[1]] > 1


def test_one_class_scores_zero():
    docs = [np.array([1, 2]), np.array([2, 3])]
    for y in (np.zeros(2, np.int64), np.ones(2, np.int64)):
        m = x.fit(docs, y)
        assert m.scores(docs).tolist() == [0.0, 0.0]
    assert x.fit([], np.zeros(0, np.int64)).scores(docs).tolist() == [0.0, 0.0]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (7, 1), (7, 0), (None, 1), (6, None), (99, 1), (9, 0)], "doc_id long, toxic int")
    model = x.fit_toxicity(odd_docs, labels)
    rows = x.toxicity(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert x.toxicity(no_docs, model).count() == 0 and x.fit_toxicity(no_docs, labels).fitted is False
    assert x.fit_toxicity(odd_docs, labels.limit(0)).fitted is False
    kept = x.drop_toxic(odd_docs, x.fit_toxicity(odd_docs, labels.limit(0)))
    assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count()


def test_sample_is_bounded_and_leaves_out_the_held_out(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('t', id) as text")
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 4 = 0 as int) as toxic")
    got, y = x.training_sample(docs, labels, max_positive=50, max_negative=70)
    assert len(got) == 120 and y.sum() == 50
    learnt = {x.word_buckets(f"t{i}".encode())[0] for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert all(any(int(b) in learnt for b in row) for row in got)
    assert sorted(x.word_buckets(b"(Word!)"))[:1] and x.word_buckets(b"...") == []


def test_a_term_that_matters_in_a_pair_alone():
    rng = np.random.default_rng(1)
    docs, y = [], []
    for i in range(6000):
        insult, group = i % 4 == 0, i // 4 % 2 == 0  # the group is in half of the documents of either class
        toxic = (insult and group) or (not group and i % 4 == 1)  # there, something else is toxic
        docs.append(np.array([0] * insult + [1] * group + [2] * (toxic and not insult) + sorted(rng.choice(np.arange(3, 60), 5, replace=False).tolist()), np.int64))
        y.append(int(toxic))
    y = np.array(y)
    has = np.array([1 in d for d in docs])
    assert abs(has[y == 1].mean() - has[y == 0].mean()) < 1e-9  # chi-square 0
    m = x.fit(docs[:4000], y[:4000], epochs=15)
    assert 1 in m.index and len(m.index) < 20
    rows = [np.array([m.index[int(t)] for t in d if int(t) in m.index], np.int64) for d in docs[4000:]]
    assert ((m.scores(rows) >= 0.5) == y[4000:]).mean() > 0.99
    assert 1 not in x.fit(docs[:4000], y[:4000], epochs=1, min_joint=np.inf, min_pair=np.inf).index


def machine(seed, size=9, factors=3):
    rng = np.random.default_rng(seed)
    return x.FactorizationMachine({i: i for i in range(size)}, 0.3, rng.normal(size=size), rng.normal(size=(size, factors)))


DOCS = [np.array(d, np.int64) for d in ([0, 1, 5], [], [8], [2, 3, 4, 5, 6, 7], [0, 8], list(range(9)))]


def test_logits_are_the_double_sum():
    m = machine(1)
    for d, got in zip(DOCS, m.logits(DOCS), strict=True):
        pairs = sum(m.factors[i] @ m.factors[j] for a, i in enumerate(d) for j in d[a + 1 :])
        assert np.isclose(got, m.bias + sum(m.linear[i] for i in d) + pairs)
    assert m.logits([]).tolist() == []


def test_gradient_against_finite_differences():
    m, y, eps = machine(2), np.array([1, 0, 1, 0, 0, 1]), 1e-6

    def loss():
        p = m.scores(DOCS)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    db, dw, dv = m.gradient(DOCS, y)

    def slope(add):
        add(eps)
        up = loss()
        add(-2 * eps)
        down = loss()
        add(eps)
        return (up - down) / (2 * eps)

    def bias(by):
        m.bias += by

    assert np.isclose(slope(bias), db, atol=1e-6)
    for i in range(9):
        assert np.isclose(slope(lambda by: m.linear.__setitem__(i, m.linear[i] + by)), dw[i], atol=1e-6)  # noqa: B023
        for k in range(3):
            assert np.isclose(slope(lambda by: m.factors.__setitem__((i, k), m.factors[i, k] + by)), dv[i, k], atol=1e-6)  # noqa: B023


def test_a_pair_of_which_neither_term_matters_alone():
    """Toxic where exactly one of two frequent terms is: each term's own statistic is about 0."""
    rng = np.random.default_rng(4)
    docs, y = [], []
    for i in range(6000):
        a, b = i % 2 == 0, i // 2 % 2 == 0
        docs.append(np.array([0] * a + [1] * b + sorted(rng.choice(np.arange(2, 60), 6, replace=False).tolist()), np.int64))
        y.append(int(a != b))
    y = np.array(y)
    m = x.fit(docs[:4000], y[:4000], epochs=25)
    assert {0, 1} <= set(m.index) and len(m.index) < 10
    rows = [np.array([m.index[int(t)] for t in d if int(t) in m.index], np.int64) for d in docs[4000:]]
    assert ((m.scores(rows) >= 0.5) == y[4000:]).mean() > 0.99
    assert 0 not in x.fit(docs[:4000], y[:4000], epochs=1, min_pair=np.inf).index


def test_sample_is_bounded_in_terms(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 50), k -> concat('t', id, 'x', k))) as text")
    labels = spark.range(300).selectExpr("id as doc_id", "cast(id % 4 = 0 as int) as toxic")
    whole, _ = x.training_sample(docs, labels)
    some, _ = x.training_sample(docs, labels, max_terms=2000)
    assert sum(map(len, some)) <= 2000 < sum(map(len, whole)) and len(some) > 5
