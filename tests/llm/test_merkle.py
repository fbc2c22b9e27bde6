import hashlib

import pytest
from pyspark.sql import functions as F

from calibrix.llm import merkle


def brute(rows):
    """By (doc_id, text): (n_chars, edited text's hash) of rows in descending order of id, then by text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        n, following = len(t), rows[(k + 1) % len(rows)][1]
        edited = t[: n - n // 2] + following[: n // 2]
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), t, edited, following))
    return out


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_every_row_is_edited_by_the_next(spark, odd_docs, buckets):
    more = spark.range(300).selectExpr("id * id * 7 as doc_id", "concat('text ', id % 50, '. line\n', id, ', end é') as text")
    docs = odd_docs.select("doc_id", "text").union(more)
    got = merkle.fingerprints(docs, buckets=buckets).collect()
    expect = brute([tuple(r) for r in docs.collect()])
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((str(i), n, h) for i, n, h, *_ in expect)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    # Equal roots if and only if the texts are equal.
    roots = {}
    for r in got:
        roots.setdefault(r.fingerprint, set()).add((r.n_chars, r.doc_id))
    assert len(roots) == len({t for *_, t, _, _ in expect})


def trees(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", merkle.tree(F.col("t")).alias("x"))


def compare(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.tree(F.col("a")).alias("a"), merkle.tree(F.col("b")).alias("b"))
    return df.select(merkle.likeness(df["a"], df["b"]), merkle.differing_sections(df["a"], df["b"]),
                     merkle.differing_paragraphs(df["a"], df["b"]), F.size("a.sections"), F.size("a.paragraphs")).first()


def test_tree_nodes(spark):
    lines = [f"line {i}, of some text." for i in range(40)] + ["", "after a blank line"]
    x = trees(spark, "\n".join(lines)).first().x
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    parts = spark.createDataFrame(list(enumerate(lines)), "i int, t string").select("i", merkle.phrases(F.col("t")).alias("p")).orderBy("i").collect()
    nodes = [sha("paragraph:" + ",".join(map(str, r.p)) + ":" + line) for r, line in zip(parts, lines)]
    assert x.paragraphs == nodes and x.leaves == [q for r in parts for q in r.p]
    assert [sum(q >> 1 & 127 for q in r.p) for r in parts] == [len(line) for line in lines] and not any(q & 1 for q in x.leaves)
    cuts = [0] + [i + 1 for i, n in enumerate(nodes[:-1]) if n[0] in "01" or not lines[i].strip()] + [len(nodes)]
    sections = [sha("section:" + "".join(nodes[a:b])) for a, b in zip(cuts, cuts[1:])]
    assert [s.node for s in x.sections] == sections and [s.first for s in x.sections] == [c + 1 for c in cuts[:-1]]
    assert x.root == sha("root:" + "".join(sections))


def test_edits_are_located(spark):
    lines = [f"paragraph {i} says this; and that. {i * i}" for i in range(60)]
    text = "\n".join(lines)
    other = "\n".join([*lines[:20], "something else entirely", *lines[21:]])
    like, sections, paragraphs, n_sections, n = compare(spark, text, other)
    assert paragraphs == [21] and 1 <= len(sections) <= 2 and n_sections > 3 and n == 60 and 0.9 < like < 1
    assert compare(spark, text, text)[:3] == (1.0, [], [])
    # A paragraph put in front leaves later sections as they are.
    assert len(compare(spark, text, "new first line\n" + text)[1]) <= 1
    assert compare(spark, "", "")[0] == 1.0 and compare(spark, "", "abc")[0] == 0.0 and compare(spark, "a", "b")[0] == 0.0


def test_none_and_one(spark, no_docs):
    assert merkle.fingerprints(no_docs).count() == 0
    one = merkle.fingerprints(spark.createDataFrame([(5, "abcdef", 1)], "doc_id long, text string, following int")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0


def test_native_plan(odd_docs):
    plan = merkle.fingerprints(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "SinglePartition" not in plan


MARKS = ".!?;:,|\u3001\u3002\uFF01\uFF0C\uFF1A\uFF1B\uFF1F\u2026"


def plain_phrases(line):
    """The cuts by a loop over the code points."""
    span = lambda *pairs: {chr(c) for lo, hi in pairs for c in range(lo, hi + 1)}
    some = {*"0qQ\u0435\u3044\u306E"} | span((0x4E00, 0x52FF))
    last = {*"dgmtyDGMTY0123"} | span((0xE0, 0xEA), (0x3B1, 0x3B8), (0x430, 0x438), (0x5D0, 0x5D8), (0x621, 0x62B), (0x904, 0x920))
    out, at, i = [], 0, 0
    while i < len(line):
        j = i
        if line[i] in MARKS:
            while j < len(line) and line[j] in MARKS:
                j += 1
            while j < len(line) and line[j] in " \t":
                j += 1
        elif line[i] in last and i + 1 < len(line) and line[i + 1] in " \t":
            j = i + 1
            while j < len(line) and line[j] in " \t":
                j += 1
        elif line[i] in some and i >= 32 and not any(c.isspace() for c in line[i - 32 : i]):
            j = i + 1
        if j > i:
            out.append(line[at:j])
            at = i = j
        else:
            i += 1
    out.append(line[at:])
    cut = [p for x in out for p in ([x[k : k + 64] for k in range(0, len(x), 64)] or [""])]
    return [p for p in cut if p]


def plain_likeness(a, b):
    from collections import Counter

    if a == b:
        return 1.0
    x, y = (Counter(p for line in t.split("\n") for p in plain_phrases(line)) for t in (a, b))
    total = sum(len(p) * n for c in (x, y) for p, n in c.items())
    return 2 * sum(len(p) * n for p, n in (x & y).items()) / total if total else 0.0


def test_likeness_against_brute_force(spark):
    import random

    rng = random.Random(8)
    words = ["alpha", "of", "to", "beta", "gamma,", "x", "delta.", "epsilon", "\u6F22\u5B57", "the", "a" * 40, "q0" * 50, "rq" * 40, "end", "d"]
    pairs = []
    for _ in range(120):
        a = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))).replace("delta. ", "delta.\n")
        b = a[: len(a) // 2] + " ".join(rng.choice(words) for _ in range(rng.randint(0, 20))) if rng.random() < 0.7 else rng.choice(pairs or [("", "")])[0]
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", merkle.likeness(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("x"))
    for r in df.collect():
        assert abs(r.x - plain_likeness(r.a, r.b)) < 1e-9, (r.a, r.b)


def test_near_copies_of_any_kind_are_alike_and_others_are_not(spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvwyz") for _ in range(rng.randint(1, 9)))
    unpunctuated = [" ".join(word() for _ in range(400)) for _ in range(2)]
    run = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(3000)) for _ in range(2)]
    han = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1500)) for _ in range(2)]
    repetitive = ["one line that repeats\n" * 300, "another line, not the same\n" * 300]
    rows = []
    for kind in (unpunctuated, run, han, repetitive):
        a, b = kind
        for near in (a[:10] + "X" + a[10:], a[: len(a) // 2] + "something new " + a[len(a) // 2 :], a[: len(a) * 2 // 3]):
            rows.append((a, near, True))
        rows.append((a, b, False))
    rows.append(("a" * 1000, "a", False))
    df = spark.createDataFrame(rows, "a string, b string, near boolean").select("near", merkle.likeness(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("x"))
    got = [(r.near, r.x) for r in df.collect()]
    assert not [g for g in got if (g[1] <= 0.5 if g[0] else g[1] >= 0.1)]


def test_a_nul_in_a_text_is_told_apart(spark):
    roots = {r.x.root for r in trees(spark, "one, two", "one, \x00two", "one\x00, two", "one, two\x00").collect()}
    assert len(roots) == 4
