import random
import re

import numpy as np
import pytest
import xxhash

from calibrix.llm import simhash as s


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for x in shingles:
        h = xxhash.xxh64_intdigest(x, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fps, ids, bits=3):
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                label[find(i)] = find(j)
    out, low = [find(i) for i in range(len(fps))], {}
    for c, i in zip(out, ids):
        if i is not None:
            low[c] = min(i, low.get(c, i))
    return [low.get(c) for c in out]


def test_fingerprints(odd_docs):
    texts = ["", " ", "One", "one TWO", "ÀÉ a\x1cb\x0bc d e", "a b c " * 40, None]
    for t in texts:
        assert s.simhash(None if t is None else t.encode()) == brute_fingerprint(t)
    assert s.simhash(b"x" * 3_000_000) == xxhash.xxh64_intdigest(b"x" * 3_000_000, 42)
    rnd = random.Random(1)
    long_text = " ".join(rnd.choice(["alpha", "Beta", "c", "d" * 50]) for _ in range(120_000))  # several blocks
    assert len(long_text) > 1 << 20 and s.simhash(long_text.encode()) == brute_fingerprint(long_text)
    got = sorted((str(r.doc_id), r.fp) for r in s.fingerprints(odd_docs).collect())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert got == sorted((str(r.doc_id), signed(brute_fingerprint(r.text))) for r in odd_docs.collect())


def planted(seed, groups, size, flips):
    rnd = random.Random(seed)
    fps = []
    for _ in range(groups):
        centre = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, size)):
            x = centre
            for b in rnd.sample(range(64), rnd.randrange(flips + 1)):
                x ^= 1 << b
            fps.append(x)
            if rnd.random() < 0.3:
                centre = x  # chains
    return fps


@pytest.mark.parametrize(("bits", "cell_rows", "pivots"), [(3, 2048, 24), (3, 3, 24), (3, 7, 2), (1, 5, 8), (5, 50, 24)])
def test_links_lose_none(spark, bits, cell_rows, pivots):
    fps = sorted(set(planted(bits, 40, 12, bits) + planted(9, 1, 90, 2) + [0, (1 << 64) - 1, 1]))
    a = np.array(fps, np.uint64)
    classes = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    edges = [(r.u, r.v) for r in s.links(classes, bits, pivots, cell_rows).collect()]
    place = {int(x): i for i, x in enumerate(a.view(np.int64))}
    assert all((fps[place[u]] ^ fps[place[v]]).bit_count() <= 64 and u > v for u, v in edges)
    got = s.forest(len(fps), np.array([place[u] for u, _ in edges], int), np.array([place[v] for _, v in edges], int))
    expect = brute_components(fps, list(range(len(fps))), bits)
    assert got.tolist() == expect


def test_pivot_distances_bound_distances():
    a = np.array(planted(3, 30, 8, 3), np.uint64)
    t = s.pivot_table(a).astype(int)
    for i in range(len(a)):
        assert (np.abs(t - t[i]).max(axis=1) <= np.bitwise_count(a ^ a[i])).all()


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(2)
    edges = [(i + 1, i) for i in range(60)] + [(1000 + i, 1000) for i in range(1, 50)] + [(5000, 4000), (6000, 5000), (6000, 3999)]
    edges += [tuple(sorted(rnd.sample(range(7000, 7200), 2), reverse=True)) for _ in range(150)]
    edges = sorted(set(edges))
    got = {r.node: r.root for r in s.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    root = s.forest(len(nodes), np.array([place[u] for u, _ in edges]), np.array([place[v] for _, v in edges]))
    expect = {x: nodes[root[i]] for i, x in enumerate(nodes) if nodes[root[i]] != x}
    assert got == expect
    assert s.components(spark.createDataFrame([], "u long, v long")).count() == 0


def check(docs, rows):
    want = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in want]
    comp = brute_components(fps, [i for i, _ in want])
    assert sorted((str(i), f"{f:016x}", str(c if c is not None else i)) for (i, _), f, c in zip(want, fps, comp)) == sorted(
        (str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows)
    return comp


def test_near_duplicates(spark, odd_docs, no_docs):
    check(odd_docs, s.near_duplicates(odd_docs).collect())
    assert s.near_duplicates(no_docs).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    comp = check(docs, s.near_duplicates(docs).collect())
    kept = s.drop_near_duplicates(docs)
    assert kept.schema == docs.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp))


def test_one_row_of_each_component_stays(odd_docs, no_docs):
    kept = s.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    # 1 and 2 are equal; 3, 4, 5 and the row of no id and text are empty; 7 is repeated, its other text is another document.
    rows = sorted((str(r.doc_id), (r.text or "")[:20]) for r in kept.collect())
    assert rows == sorted([("1", "one two three four f"), ("3", ""), ("6", "alpha beta gamma del"), ("7", "x"), ("7", "another text under t"),
                           ("None", "no id here"), ("9", "naïve café 漢字 🙂 pass")])
    assert s.drop_near_duplicates(no_docs).count() == 0
