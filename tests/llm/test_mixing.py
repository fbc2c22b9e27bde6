import hashlib
import math

import pytest
from pyspark.sql import functions as F

from calibrix.llm import mixing


def u(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)


def draw(rate, seed, key):
    parts = math.ceil(rate / mixing.STEP)
    total, mean = 0, rate / parts
    for i in range(1, parts + 1):
        p = f = math.exp(-mean)
        k = 0
        while f <= u(seed, key, i):
            k += 1
            p *= mean / k
            f += p
        total += k
    return total


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "w" * (1 + i % 9), "en", "big" if i % 3 else ("small" if i % 6 else None), 1 + i % 9) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("weights", [None, {"big": 1.0, "small": 3.0, None: 0.5}, {"small": 1.0}])
def test_counts_are_inverted_poisson_draws(docs, weights):
    epochs = 8.0  # the third case has rates beyond STEP
    rates = {r.source: r.rate for r in mixing.source_rates(docs, weights, epochs=epochs).collect()}
    if weights == {"small": 1.0}:
        assert rates["small"] > mixing.STEP
    got = {r.doc_id: r.n for r in mixing.mix(docs, weights, epochs=epochs).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    expect = {r.doc_id: draw(rates[r.source], 42, r.doc_id) for r in docs.collect() if rates[r.source] > 0}
    assert got == {k: n for k, n in expect.items() if n}


def test_shares_meet_the_weights(docs):
    out = mixing.mix(docs, {"big": 1.0, "small": 1.0, None: 2.0}, epochs=40.0)
    chars = {r.source: r.n for r in out.groupBy("source").agg(F.sum("n_chars").alias("n")).collect()}
    total = sum(chars.values())
    assert abs(total / docs.agg(F.sum("n_chars")).first()[0] - 40) < 2
    assert abs(chars[None] / total - 0.5) < 0.03 and abs(chars["big"] / total - 0.25) < 0.03


def test_same_draws_in_any_partitioning_and_an_order_by_hash(docs):
    a = mixing.mix(docs, copy="copy", position="position")
    b = mixing.mix(docs.repartition(7), copy="copy", position="position")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(a) == rows(b)
    for part in a.select("position").rdd.glom().collect():
        assert [r[0] for r in part] == sorted(r[0] for r in part)
    assert all(r.position == u(43, r.doc_id, r.copy) for r in a.collect())


def test_odd_rows(odd_docs, no_docs):
    out = mixing.mix(odd_docs, epochs=5.0)
    assert out.columns == odd_docs.columns
    ids = {r.doc_id for r in out.collect()}
    assert ids <= {r.doc_id for r in odd_docs.collect()} and out.count() > 0
    assert mixing.mix(no_docs).count() == 0
    nothing = odd_docs.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix(nothing).count() == 0
    assert mixing.mix(odd_docs, weights={}).count() == 0


def test_native_plan(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
