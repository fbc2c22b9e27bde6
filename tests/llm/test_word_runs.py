import hashlib
import random
import zlib

import pytest

from calibrix.llm import word_runs as W
from calibrix.llm.common import table
from calibrix.llm.queries import op13_word_runs


def brute_lyndon(s):
    return [max(k for k in range(1, len(s) - i + 1) if all(s[i : i + k] < s[i + j : i + k] for j in range(1, k))) for i in range(len(s))]


def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            stretch = w[i : j + q]
            if len(stretch) >= max(6, 4 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((i, len(stretch), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_tail(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def sequences(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        if s and rng.random() < 0.6:
            part = s[: rng.randint(1, len(s))]
            s = s[:5] + part * rng.randint(1, 6) + part[: rng.randint(0, len(part))]
        yield s


def test_lyndon_array_in_both_orders():
    for s in sequences(1, 300):
        for t in (s[:25], [-x for x in s[:25]]):
            assert W.lyndon_array(t) == brute_lyndon(t)


def test_runs_against_brute_force():
    for s in sequences(2, 1500):
        words = [b"w%d" % x for x in s]
        runs = W.runs_of(words)
        assert runs == brute_runs(words)
        dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
        assert W.collapsed(words, runs) == [w for i, w in enumerate(words) if i not in dropped]


def test_long_periods_and_nested_runs():
    rng = random.Random(3)
    base = [b"%d" % rng.randrange(30) for _ in range(900)]
    inner = base[:400] + [b"x"] * 50 + base[400:]
    words = [b"before"] + inner * 5 + inner[:77] + [b"after"]
    assert W.runs_of(words) == sorted([(1, 5 * 950 + 77, 950), *[(401 + 950 * k, 50, 1) for k in range(5)]])
    assert W.runs_of([b"a"] * 100_000) == [(0, 100_000, 1)]


@pytest.mark.parametrize("doc_id", range(200))
def test_the_edit(doc_id):
    words = [b"%d" % i for i in range(doc_id % 37)]
    assert W.repeated_tail(doc_id, words) == brute_tail(doc_id, words)


def expected(doc_id, text, edit=brute_tail):
    words = edit(doc_id, (text or "").encode().split())
    runs = brute_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    got = {r.doc_id: tuple(r) for r in op13_word_runs(spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == set(docs) and any(r[1] for r in got.values())
    for doc_id, text in docs.items():
        if len(text) < 8000:
            assert got[doc_id] == expected(doc_id, text)


def test_odd_rows(spark, odd_docs):
    rows = W.periodic_runs(odd_docs)
    assert rows.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = {(r.doc_id, r.n_words): r for r in rows.collect()}
    assert rows.count() == odd_docs.count()
    assert got[6, 240_002].runs == [(0, 240_000, 4)] and got[6, 240_002].collapsed == "alpha beta gamma delta the end"
    assert got[3, 0].runs == [] and got[3, 0].collapsed == "" and got[None, 3].collapsed == "no id here"
    assert {(r.n_runs, r.start) for r in W.digests(W.periodic_runs(odd_docs.where("doc_id is null"))).collect()} == {(0, None)}


def test_empty_table(spark, no_docs):
    assert W.digests(W.periodic_runs(no_docs)).collect() == []


def test_other_columns(spark):
    df = spark.createDataFrame([("go " * 9, "x")], "body string, doc_id string")
    row = W.periodic_runs(df, "doc_id", "body").first()
    assert (row.doc_id, [tuple(r) for r in row.runs], row.collapsed) == ("x", [(0, 9, 1)], "go")
