import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from calibrix.llm import quality_rules as q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i : i + 8]), []).append(i)
    repeated = {p for v in at.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\té#| \x1c漢", max_size=200))
def test_counts(text):
    assert q.counts(text.encode())[:5] == brute(text)


def test_repeated_windows():
    rnd = random.Random(3)
    for _ in range(60):
        words = [rnd.choice("abc") for _ in range(rnd.randrange(60))] + list("xyzabcde") * rnd.randrange(4)
        text = " ".join(words)
        assert q.counts(text.encode())[4] == brute(text)[4]


def test_rules_cover_planted_classes():
    rng = np.random.default_rng(1)
    n = 4000
    x = {"a": rng.random(n), "b": rng.random(n), "c": rng.random(n)}
    bad = ((x["a"] > 0.8) & (x["b"] <= 0.3)) | (x["c"] > 0.95)
    rules = q.learn(x, bad, np.arange(n) % 3 == 0)
    new = {k: rng.random(n) for k in x}
    truth = ((new["a"] > 0.8) & (new["b"] <= 0.3)) | (new["c"] > 0.95)
    said = np.zeros(n, bool)
    for r in rules:
        said |= q.matches(r, new, n)
    assert (said == truth).mean() > 0.98 and 2 <= len(rules) <= 8 and all(len(r) <= q.MAX_CONDITIONS for r in rules)


def test_no_rules_without_both_classes():
    x = {"a": np.arange(30.0)}
    for bad in (np.zeros(30, bool), np.ones(30, bool)):
        assert q.learn(x, bad, np.arange(30) % 3 == 0) == []
    assert q.learn({"a": np.zeros(0)}, np.zeros(0, bool), np.zeros(0, bool)) == []


def test_list_as_conditional_expression(spark):
    rules = [(q.Condition("a", True, 2.0), q.Condition("b", False, 1.0)), (q.Condition("b", True, 5.0),)]
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0), (2.0, 1.0), (0.0, 6.0)], "a double, b double")
    assert [r[0] for r in df.select(q.verdict(rules)).collect()] == [False, True, True, False]
    assert df.select(q.verdict([])).first()[0] is True


def test_odd_rows(odd_docs, no_docs, spark):
    rows = q.quality(odd_docs, [(q.Condition("words", True, 1000.0),)]).collect()
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    expect = sorted([str(i), *brute(t or "")] for i, t in [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sorted([str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] for r in rows) == expect
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed) for r in rows)
    assert texts and q.quality(no_docs, []).count() == 0
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (7, 0), (2, None)], "doc_id long, quality int")
    assert q.fit_rules(odd_docs, labels) == [] and q.fit_rules(no_docs, labels) == [] and q.fit_rules(odd_docs, labels.limit(0)) == []


def test_held_out_labels(spark):
    from calibrix.llm.common import table

    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rules = q.fit_rules(docs, labels.where("doc_id % 2 = 0"))
    out = q.quality(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where(~F.col("base_failed")).collect()
    right = sum(r.kept == (r.quality == 1) for r in out)
    assert rules and right >= 0.95 * len(out)


def test_repeated_and_textual_ids_give_one_list(spark):
    """An id's several texts, in any order and partitioning, and ids that aren't numbers."""
    rows = [(f"d{i}", ("## " * 40 if i % 3 == 0 else "plain words of a text " * 12) + str(i)) for i in range(90)]
    rows += [(f"d{i}", "another text under the id " * (i + 5)) for i in range(0, 90, 5)]
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 > 0)) for i in range(90)], "doc_id string, quality int")
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    lists = {tuple(q.fit_rules(some, labels)) for some in (docs, docs.repartition(7), docs.orderBy("text", ascending=False))}
    assert len(lists) == 1 and len(next(iter(lists))) >= 1
