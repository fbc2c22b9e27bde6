import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from calibrix.llm import spelling as S
from calibrix.llm.common import table
from calibrix.llm.queries import op12_spelling_variants

D = "/root/testdata/sf0.01"


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(count):
    """Rows by direct definition; words are compared if they share a word less one letter, or less one letter at a place."""
    near, gaps = defaultdict(set), defaultdict(set)
    for w in count:
        for i in range(len(w)):
            gaps[w[:i] + "_" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in count:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for some in gaps.values():
        for a in some:
            near[a] |= some - {a}
    form = {}
    for w in count:
        if near[w]:
            best = min(near[w], key=lambda x: (-count[x], x))
            if count[best] >= 10 * count[w]:
                form[w] = best
    out = {}
    for w in count:
        root = w
        while root in form:
            root = form[root]
        out[w] = (w, form.get(w), root, count[w], len(near[w]), count[form[w]] if w in form else None)
    return out


def vocabulary(seed, size=900, letters="abéÿz×", lengths=(7, 8, 9)):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice(lengths))) for _ in range(size)}
    return {w: int(10 ** rng.uniform(0.4, 4)) for w in sorted(words)}


@pytest.mark.parametrize("limit", [S.LIMIT, 3000, 500])
def test_forms_against_brute_force(spark, limit):
    """Whole nodes, nodes divided by further levels, and tiles of leaves give the same."""
    count = vocabulary(1)
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    assert {r.word: tuple(r) for r in S.spelling_forms(df, limit=limit).collect()} == brute(count)


def test_brute_force_is_the_definition():
    count = vocabulary(2, 150)
    rows = brute(count)
    assert all(rows[w][4] == sum(one_apart(w, v) for v in count) for w in count)


def test_pairs_of_each_kind():
    pairs = [("abcdefg", "abcdefx"), ("abcdefg", "abcdefgg"), ("abcdefg", "xabcdefg"), ("abcdefg", "abdcefg"), ("aabcdef", "abcdeff"), ("ab", "ab")]
    for a, b in pairs:
        if len(a) <= len(b):
            x, y = (np.frombuffer(w.encode("latin-1"), np.uint8)[None] for w in (a, b))
            assert bool(S.near(x, y)[0]) == one_apart(a, b)


def test_search_meets_every_pair_once():
    """From the trie's root: each pair of words one apart is met from one side, with words of one leaf from both."""
    words = sorted(w for w in vocabulary(3, 400, "abcé", (7,)))
    counts = S.vectors(S.letters([w.encode("latin-1") for w in words], 7))
    leaves, leaf = np.unique(counts, axis=0, return_inverse=True)
    met = Counter()
    for q, at in S.search(leaves, counts, np.full(len(words), S.WHOLE), 0):
        met.update(zip(q.tolist(), at.tolist(), strict=True))
    assert set(met.values()) == {1}
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if one_apart(a, b):
                both = ((i, leaf.ravel()[j]) in met) + ((j, leaf.ravel()[i]) in met)
                assert both == (2 if leaf.ravel()[i] == leaf.ravel()[j] else 1)


def expected_counts(docs):
    total = Counter()
    for doc_id, text in docs:
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for w in re.findall("[a-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= 2}


def test_query_against_brute_force(spark):
    count = expected_counts([(r.doc_id, r.text) for r in table(spark, D, "documents").collect()])
    got = {r.word: tuple(r) for r in op12_spelling_variants(spark, D).collect()}
    exp = brute(count)
    assert got == exp and sum(r[1] is not None for r in exp.values()) > 100


def test_odd_rows(spark, odd_docs):
    text = "Straße STRASSE strasse ÉCOLEÉCOLE école " * 3
    more = spark.createDataFrame([(None, text), (20, None), (21, ""), (22, "x" * 2000), (22, "x" * 2001 + " " + "x" * 2000)],
                                 "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionAll(more)
    got = {r.word: (r.n, r.n_near) for r in S.spelling_variants(docs, drop=31).collect()}
    want = brute(expected_counts([("" if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()]))
    assert got == {w: (r[3], r[4]) for w, r in want.items()} and max(map(len, got)) == 2000


def test_very_long_words(spark):
    long = "ab" * 150_000
    rows = [(long, 50), (long + "x", 4), (long[1:], 5), (long[:-1] + "c", 1), ("b" + long[:-1], 7)]
    got = {r.word: (r.n, r.n_near, r.form) for r in S.spelling_forms(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {long: (50, 3, None), rows[1][0]: (4, 1, long), rows[2][0]: (5, 2, long), rows[3][0]: (1, 1, long), rows[4][0]: (7, 1, None)}


def test_repeated_and_null_words_and_other_columns(spark):
    df = spark.createDataFrame([("letters", 3, "a"), ("letters", 2, "b"), (None, 5, "c"), ("lettres", 1, "d"), ("lettersx", 90, "e")],
                               "w string, n long, word string")
    got = sorted(tuple(r) for r in S.spelling_forms(df, "w", "n").collect())
    assert got == [("letters", "lettersx", "lettersx", 5, 1, 90), ("lettersx", None, "lettersx", 90, 1, None), ("lettres", None, "lettres", 1, 0, None)]


def test_chains_end_at_the_root(spark):
    chain = [("aaaaaaa" + "b" * k, 10**k) for k in range(6)]
    got = {r.word: r.root for r in S.spelling_forms(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {chain[-1][0]}


def test_empty_table(spark, no_docs):
    assert S.spelling_variants(no_docs, drop=31).collect() == []
    with pytest.raises(ValueError):
        S.spelling_forms(S.word_counts(no_docs), ratio=1)
