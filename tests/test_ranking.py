"""global_rank / prefix_sum against plain Python sorting, over several ranges, with heavy ties and skew."""

import bisect
import random

import pandas as pd
import pytest

from calibrix.operators.ranking import cut_index, cut_points, global_rank, ordered, prefix_sum, shuffle_partitions


def _frame(spark, n, n_keys, seed, parts=("a", "b")):
    rnd = random.Random(seed)
    rows = [(i, float(rnd.randrange(n_keys)) / 7.0, rnd.choice(parts)) for i in range(n)]
    # one very hot key: a third of the rows
    rows += [(n + i, 0.5, "a") for i in range(n // 2)]
    return spark.createDataFrame(rows, "id long, k double, p string")


@pytest.mark.parametrize("n_keys", [3, 40, 1000])
def test_global_rank_matches_sort(spark, n_keys):
    df = _frame(spark, 120, n_keys, n_keys)
    got = global_rank(df, "k", "id", partition_by=["p"], out="r").toPandas()
    exp = got[["id", "k", "p"]].sort_values(["p", "k", "id"]).copy()
    exp["r_exp"] = exp.groupby("p").cumcount() + 1
    m = got.merge(exp[["id", "r_exp"]], on="id")
    assert len(m) == len(got)
    assert (m["r"] == m["r_exp"]).all()


def test_global_rank_in_any_partitioning(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k double")
    a = global_rank(df, "k", "id", out="r").toPandas().sort_values("id")
    b = global_rank(df.repartition(7), "k", "id", out="r").toPandas().sort_values("id")
    exp = sorted(rows, key=lambda t: (t[1], t[0]))
    pos = {t[0]: i + 1 for i, t in enumerate(exp)}
    assert list(a["r"]) == [pos[i] for i in a["id"]]
    assert list(a["r"]) == list(b["r"])


@pytest.mark.parametrize("strict", [True, False])
def test_prefix_sum(spark, strict):
    rnd = random.Random(11)
    rows = [(p, float(k), rnd.randrange(10)) for p in ("x", "y") for k in rnd.sample(range(500), 60)]
    df = spark.createDataFrame(rows, "p string, k double, c long")
    got = prefix_sum(df, "k", ["c"], partition_by=["p"], strict=strict).toPandas()
    pdf = pd.DataFrame(rows, columns=["p", "k", "c"]).sort_values(["p", "k"])
    pdf["exp"] = pdf.groupby("p")["c"].cumsum() - (pdf["c"] if strict else 0)
    m = got.merge(pdf, on=["p", "k"])
    assert len(m) == len(rows)
    assert (m["c_below"] == m["exp"]).all()


def _skewed(kind, n=20_000):
    rnd = random.Random(2)
    ids = list(range(n))
    if kind == "clustered":  # most keys crowd near 0
        keys = [rnd.random() ** 12 for _ in ids]
    elif kind == "hot":  # one key has a third of the rows
        keys = [0.25 if i % 3 == 0 else rnd.random() for i in ids]
    elif kind == "outlying id":  # all keys equal, one id far away
        ids[-1], keys = 1 << 60, [0.5] * n
    else:  # hashed ids
        ids, keys = [rnd.getrandbits(60) for _ in ids], [rnd.randrange(5) / 5 for _ in ids]
    return list(zip(ids, keys))


@pytest.mark.parametrize("kind", ["clustered", "hot", "outlying id", "hashed ids"])
def test_no_task_gets_much_more_than_its_share(spark, kind):
    """Largest range of the global order, and exact ranks over several ranges."""
    rows = _skewed(kind)
    df = spark.createDataFrame(rows, "id long, k double")
    sizes = [r["count"] for r in ordered(df, ["k", "id"]).groupBy("_rk_slice").count().collect()]
    parts = shuffle_partitions(spark)
    assert len(sizes) == parts > 1 and max(sizes) <= 2 * len(rows) / parts
    ranked = global_rank(df, "k", "id", out="r").collect()
    pos = {t[0]: i + 1 for i, t in enumerate(sorted(rows, key=lambda t: (t[1], t[0])))}
    assert all(r["r"] == pos[r["id"]] for r in ranked)


@pytest.mark.parametrize("kind", ["outlying id", "hashed ids"])
def test_id_blocks_hold_equal_shares(spark, kind):
    rows = _skewed(kind)
    df = spark.createDataFrame(rows, "id long, k double")
    cuts = cut_points(df, "id", 50)
    sizes = [r["count"] for r in df.groupBy(cut_index("id", cuts).alias("b")).count().collect()]
    assert len(sizes) == 50 and max(sizes) <= 2 * len(rows) / 50
    index = {r["id"]: r["b"] for r in df.select("id", cut_index("id", cuts).alias("b")).collect()}
    assert all(index[i] == bisect.bisect_left(cuts, i) for i, _ in rows)


def test_empty_and_null_partitions(spark):
    none = spark.createDataFrame([], "id long, k double, p string")
    assert global_rank(none, "k", "id", partition_by=["p"]).count() == 0 and cut_points(none, "id") == []
    df = spark.createDataFrame([(1, 0.5, None), (2, 0.1, None), (3, 0.3, "a")], "id long, k double, p string")
    got = {r["id"]: (r["rank"], r["n"]) for r in global_rank(df, "k", "id", partition_by=["p"], total="n").collect()}
    assert got == {2: (1, 2), 1: (2, 2), 3: (1, 1)}
