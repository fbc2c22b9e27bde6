"""Edge cases and properties of the operators on tiny hand-made frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from calibrix.config import GROUPS
from calibrix.functions.math import normal_cdf
from calibrix.operators import auc as A
from calibrix.operators import groups as G
from calibrix.operators import losses as L
from calibrix.operators import prepare as P
from calibrix.operators import runs as R
from calibrix.operators.calibration import pit_rank


def test_pairwise_gap_equals_brute_force(spark):
    rnd = random.Random(3)
    xs = [(b, round(rnd.random(), 1)) for b in (0, 1) for _ in range(25)]
    ys = [(b, round(rnd.random(), 1)) for b in (0, 1) for _ in range(31)]
    got = {r["b"]: r["pairwise_gap"] for r in L.pairwise_gap(
        spark.createDataFrame(xs, "b int, v double"), spark.createDataFrame(ys, "b int, v double"), by=["b"]
    ).collect()}
    for b in (0, 1):
        xv = [v for bb, v in xs if bb == b]
        yv = [v for bb, v in ys if bb == b]
        exp = sum(abs(x - y) for x in xv for y in yv) / (len(xv) * len(yv))
        assert got[b] == pytest.approx(exp, abs=1e-12)


def _auc_brute(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_auc_ties_and_symmetry(spark):
    rnd = random.Random(8)
    rows = [(round(rnd.random(), 1), int(rnd.random() < 0.4)) for _ in range(150)]
    df = spark.createDataFrame(rows, "s double, y int")
    a = A.auc(df, "s", "y").first()["auc"]
    a_neg = A.auc(df.withColumn("s", -F.col("s")), "s", "y").first()["auc"]
    assert a == pytest.approx(_auc_brute(*zip(*rows)), abs=1e-12)
    assert a + a_neg == pytest.approx(1.0, abs=1e-12)


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(0.1, 1), (0.7, 1)], "s double, y int")
    assert A.auc(df, "s", "y").first()["auc"] is None


def test_normal_cdf_polynomial_accuracy(spark):
    zs = [i / 10.0 for i in range(-60, 61)]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(normal_cdf(F.col("z"), F.lit(0.0), F.lit(1.0))).collect()]
    for z, g in zip(zs, got):
        assert abs(g - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 2e-7


def test_early_stop_equal_losses_do_not_improve(spark):
    log = [("a", s, l) for s, l in enumerate([1.0, 0.9, 0.9, 0.9, 0.9, 0.5])]
    log += [("b", s, l) for s, l in enumerate([1.0, 0.9, 0.8, 0.95, 0.7, 0.75])]
    df = spark.createDataFrame(log, "run_id string, step long, eval_loss double")
    got = {r["run_id"]: r for r in R.early_stop(df, patience=3).collect()}
    assert got["a"]["stop_step"] == 4 and got["a"]["best_step"] == 1
    assert got["b"]["stop_step"] is None and got["b"]["best_step"] == 4 and got["b"]["best_loss"] == 0.7


def test_target_range_counts_edges(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.25), (3, 0.49), (4, 1.0), (5, 0.8)], "id long, target double")
    got = {(r["num_ranges"], r["target_range"]): r["n"] for r in P.target_range_counts(df).collect()}
    assert sum(v for (k, _), v in got.items() if k == 2) == 4  # target = 1.0 falls in no range
    assert sum(v for (k, _), v in got.items() if k == 4) == 4
    assert 0 in got.values()  # the empty [0.5, 0.75) range is reported
    with pytest.raises(ValueError):
        P.target_range_counts(df, num_ranges_list=(3,))


@pytest.mark.parametrize("n_small,kept", [(49, False), (50, True)])
def test_min_group_size_per_class(spark, n_small, kept):
    rows = [(i, 0.75, 1) for i in range(n_small)] + [(1000 + i, 0.75, 0) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, black double, target_label int")
    sizes = G.group_sizes(G.group_members(df, ["black"])).first()
    assert sizes["group_size"] == n_small and sizes["kept"] is kept
    bal = G.balanced_members(G.group_members(df, ["black"]))
    if kept:
        counts = {r["target_label"]: r["count"] for r in bal.groupBy("target_label").count().collect()}
        assert counts == {0: 50, 1: 50}
        first_zeros = sorted(r["row_id"] for r in bal.where("target_label = 0").collect())
        assert first_zeros == list(range(1000, 1050))  # first rows in id order
    else:
        assert bal.count() == 0


def test_group_membership_rule(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 0.5), (3, 0.49), (4, None)], "row_id long, black double")
    got = sorted(r["row_id"] for r in G.group_members(df, ["black"]).collect())
    assert got == [2]


def test_pit_rank_ties_and_single_row(spark):
    rows = [(i, 0.5, 0.5, 0.1) for i in range(10)] + [(10 + i, 0.9, 0.5, 0.1) for i in range(5)]
    df = spark.createDataFrame(rows, "row_id long, label double, mean double, stddev double")
    r = pit_rank(df).orderBy("pos").toPandas()
    assert list(r["row_id"]) == list(range(15))  # ties broken by id
    assert r["q"].iloc[0] == 0.0 and r["q"].iloc[-1] == 1.0
    one = pit_rank(df.limit(1)).first()
    assert one["q"] == 0.0 and one["pos"] == 1


def _comments(spark, n, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = rnd.choice([0.0, 0.005, 0.1, 0.3, 0.6, 0.9, 1.0, rnd.random()])
        g = [None if rnd.random() < 0.3 else rnd.choice([0.0, 0.5, 1.0]) for _ in GROUPS]
        rows.append((i, t, f"text {i}", *g))
    schema = "id long, target double, comment_text string, " + ", ".join(f"{g} double" for g in GROUPS)
    return spark.createDataFrame(rows, schema)


def test_null_sentinel_wipes_all_groups(spark):
    df = P.null_sentinel(_comments(spark, 50))
    for r in df.collect():
        vals = [r[g] for g in GROUPS]
        if r["stratum"] == "with_nulls":
            assert all(v == -1.0 for v in vals)
        else:
            assert all(v is not None and v != -1.0 for v in vals)


def test_stratified_drop_exact_counts(spark):
    cleaned = P.null_sentinel(_comments(spark, 400))
    plan = P.drop_plan(cleaned).toPandas()
    plan["_rng"] = plan["_rng"].fillna(-1).astype(int)
    kept = P.stratified_drop(cleaned).toPandas()
    before = plan.groupby(["stratum", "_rng"]).size()
    after = kept.merge(plan[["id", "_rng"]], on="id").groupby(["stratum", "_rng"]).size()
    shares = P.DEFAULT_DROP_SHARES
    for (s, rng), n in before.items():
        if rng == -1:  # target outside every range (1.0) is never dropped
            assert after[(s, rng)] == n
            continue
        assert after.get((s, rng), 0) == n - math.floor(n * shares[s][int(rng)])


def test_exact_split_sizes_disjoint_and_stable(spark):
    cleaned = P.null_sentinel(_comments(spark, 300))
    a = P.exact_split(cleaned).select("id", "stratum", "split").toPandas()
    b = P.exact_split(cleaned.repartition(7)).select("id", "split").toPandas()
    assert a["id"].is_unique and len(a) == 300
    assert a.sort_values("id")["split"].tolist() == b.sort_values("id")["split"].tolist()
    for s, part in a.groupby("stratum"):
        n = len(part)
        t1 = math.ceil(n * {"with_nulls": 0.25, "without_nulls": 0.5}[s])
        t2 = math.ceil(t1 * 0.67)
        t3 = math.ceil(t2 * 0.5)
        c = part["split"].value_counts().to_dict()
        assert c.get("train", 0) == n - t1 and c.get("calib", 0) == t1 - t2
        assert c.get("eval", 0) == t2 - t3 and c.get("test", 0) == t3


def test_alpha_sweep_is_linear_in_alpha(spark):
    rows = [(i, random.Random(i).random(), 0.5, 0.4, 0.2) for i in range(40)]
    fc = spark.createDataFrame(rows, "row_id long, label double, input_r double, mean double, stddev double")
    sweep = {r["coefficient"]: r["eval_loss"] for r in L.alpha_sweep(fc, [0.0, 0.3, 1.0]).collect()}
    for a in (0.0, 0.3, 1.0):
        direct = L.overall_losses(fc, a).first()["loss"]
        assert sweep[a] == pytest.approx(direct, abs=1e-12)


def _forecasts(spark, n, seed=0, one_class=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        y = rnd.uniform(0.6, 1.0) if one_class else rnd.random()
        g = [rnd.choice([-1.0, 0.0, 0.75]) for _ in GROUPS]
        rows.append((i, y, rnd.random(), 0.5 * y + 0.5 * rnd.random(), 0.05 + 0.4 * rnd.random(), *g))
    schema = "row_id long, label double, input_r double, mean double, stddev double, " + ", ".join(
        f"{g} double" for g in GROUPS)
    return spark.createDataFrame(rows, schema)


def test_confusion_counts_with_one_class(spark):
    fc = _forecasts(spark, 80, one_class=True)
    overall = G.group_metrics(fc, min_size=1).where(F.col("group") == "ALL").first()
    assert overall["tn"] + overall["fp"] == 0 and overall["fn"] + overall["tp"] == 80
    assert overall["FPR"] == 0.0


def test_group_metrics_invariant_under_repartition(spark):
    fc = _forecasts(spark, 600, seed=5)
    res = []
    for k in (1, 7, 64):
        rows = G.group_metrics(fc.repartition(k), min_size=5).orderBy("group").collect()
        res.append([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows])
    assert res[0] == res[1] == res[2]


def test_pit_of_true_model_draws_is_uniform(spark):
    from calibrix.functions.math import sample_normal

    base = spark.range(4000).select(F.col("id").alias("row_id"), F.lit(0.3).alias("mean"), F.lit(0.2).alias("stddev"))
    fc = base.withColumn("label", sample_normal("mean", "stddev", "row_id", seed=9))
    from calibrix.operators.calibration import calibration_mse

    err = calibration_mse(pit_rank(fc)).first()["pit_grid_mse"]
    assert err < 1e-3  # PIT ranks hug the uniform grid


def test_group_metrics_same_with_few_and_many_id_blocks(spark, monkeypatch):
    fc = _forecasts(spark, 700, seed=11)
    r9 = lambda rows: [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]
    whole, found = G.cut_points, []
    for parts in (1, 3, 200):
        monkeypatch.setattr(G, "cut_points", lambda df, col, n=parts: whole(df, col, n))
        found.append(r9(G.group_metrics(fc, min_size=5).orderBy("group").collect()))
    assert found[0] == found[1] == found[2]


def test_rows_without_a_label_count_nowhere(spark):
    fc = _forecasts(spark, 400, seed=3)
    some = fc.where(F.col("row_id") % 3 != 0)
    holed = fc.withColumn("label", F.when(F.col("row_id") % 3 != 0, F.col("label")))
    r9 = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    for f in (lambda x: G.group_metrics(x, min_size=5), lambda x: L.overall_losses(x), lambda x: L.alpha_sweep(x, [0.0, 0.5]),
              lambda x: L.pairwise_gap_cols(L.forecast_terms(x), "cdf", "input_r"), lambda x: L.batched_eval_loss(x, 16),
              lambda x: pit_rank(x).select("row_id", "pos", "q")):
        assert r9(f(holed)) == r9(f(some))


def test_sort_by_pit_is_in_order(spark):
    import __spark_entry__ as E

    rows = E.queries()["sort_by_pit"](spark, "/root/testdata/sf0.001").collect()
    assert [r["pos"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(a["pit"] <= b["pit"] for a, b in zip(rows, rows[1:]))


def test_normal_cdf_orders_as_erf_does(spark):
    zs = [i / 7.0 for i in range(-60, 61)] + [i * 1e-9 for i in range(50)]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    rows = df.select("z", normal_cdf(F.col("z"), F.lit(0.0), F.lit(1.0)).alias("p")).collect()
    exact = {z: 0.5 * (1 + math.erf(z / math.sqrt(2))) for z in zs}
    assert all(abs(r["p"] - exact[r["z"]]) < 1e-14 for r in rows)
    near = [r["z"] for r in sorted(rows, key=lambda r: r["p"]) if abs(r["z"]) < 5]
    assert near == sorted(near)


def test_subwords_against_a_plain_greedy_match(spark):
    """Every token, cut by trying all pieces from the longest on; ids of padded rows; null and empty texts."""
    from calibrix.operators import text as TX

    texts = ["the theatre, the then; there a cat", None, "", " ", "the the the cat then then", "überthe catcat 漢字🙂 x" + " the" * 600, "thethethe zzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = TX.subword_lookup(docs, 3).collect()
    toks = TX.tokens(docs)
    vocab = TX.build_vocab(toks)
    pieces = {r.piece: r.piece_id for r in TX.subword_pieces(vocab, 3).collect()}
    assert "the" in pieces and len(pieces) == 3 + len({c for r in toks.collect() for c in r.token}) - sum(len(p) == 1 for p in list(pieces)[:3])
    assert len(set(pieces.values())) == len(pieces)

    def plain(word):
        out = []
        while word:
            best = max((p for p in pieces if word.startswith(p)), key=len)
            out.append(pieces[best])
            word = word[len(best):]
        return out

    words = {(r.doc_id, r.pos): r for r in rows if r.token is not None}
    assert len(words) == toks.count() and {r.doc_id for r in rows} == set(range(7))
    assert all(r.piece_ids == plain(r.token) for r in words.values()) and TX.UNK_ID not in {i for r in words.values() for i in r.piece_ids}
    for r in TX.encode_pieces(TX.subword_lookup(docs, 3), 32).collect():
        flat = [i for _, w in sorted((k, w) for k, w in words.items() if k[0] == r.doc_id) for i in w.piece_ids][:30]
        assert r.input_ids == [TX.CLS_ID, *flat, TX.SEP_ID] + [TX.PAD_ID] * (30 - len(flat)) and sum(r.attention_mask) == len(flat) + 2
    assert TX.longest_pieces("a?b", {"a": 5, "b": 6, "": 1}) == [5, TX.UNK_ID, 6]


def test_lookup_never_sorts_the_tokens(spark):
    """The vocabulary's rows are hashed, also where they are too large for a broadcast; salted tokens get their ids too."""
    from calibrix.operators import text as TX

    docs = spark.createDataFrame([(i, "the cat " * 9 + f"word{i % 7}") for i in range(40)], "doc_id long, text string")
    toks = TX.tokens(docs)
    vocab = TX.build_vocab(toks)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = TX.lookup(toks, vocab, hot_rows=100)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any(line.count("ShuffledHashJoin") and "_salt" in line for line in plan.splitlines())
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert len(rows) == toks.count() and all(r.token_id == ids[r.token] for r in rows)


def test_subwords_of_the_first_positions(spark):
    """Only these tokens are looked up; the others count for the vocabulary. The padded ids are those of all tokens."""
    from calibrix.operators import text as TX

    docs = spark.createDataFrame([(0, "ab cd " * 30 + "late " * 50), (1, None), (2, "late ab")], "doc_id long, text string")
    every, first = TX.subword_lookup(docs, 2), TX.subword_lookup(docs, 2, first=10)
    key = lambda r: (r.doc_id, -1 if r.pos is None else r.pos)
    assert sorted(first.collect(), key=key) == [r for r in sorted(every.collect(), key=key) if r.pos is None or r.pos < 10]
    assert {r.doc_id: r for r in TX.encode_pieces(first, 12).collect()} == {r.doc_id: r for r in TX.encode_pieces(every, 12).collect()}
