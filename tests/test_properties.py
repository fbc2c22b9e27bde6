"""Generated inputs (hypothesis) for the exact primitives: rank, all-pairs gap and AUC against
plain Python on the same rows, with heavy ties and sparse ids."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from calibrix.operators import auc as A
from calibrix.operators import losses as L
from calibrix.operators.ranking import global_rank

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
vals = st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) | st.floats(0, 1), min_size=1, max_size=60)


@SETTINGS
@given(keys=vals, parts=st.integers(1, 3))
def test_rank_equals_sort(spark, keys, parts):
    rows = [(i, float(k), i % parts) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "id long, k double, p int")
    got = {r["id"]: r["r"] for r in global_rank(df, "k", "id", partition_by=["p"], out="r").collect()}
    for p in range(parts):
        order = sorted((t for t in rows if t[2] == p), key=lambda t: (t[1], t[0]))
        for pos, t in enumerate(order, start=1):
            assert got[t[0]] == pos


@SETTINGS
@given(xs=vals, ys=vals)
def test_pairwise_gap_equals_brute_force(spark, xs, ys):
    x = spark.createDataFrame([(float(v),) for v in xs], "v double")
    y = spark.createDataFrame([(float(v),) for v in ys], "v double")
    got = L.pairwise_gap(x, y).first()["pairwise_gap"]
    exp = sum(abs(a - b) for a in xs for b in ys) / (len(xs) * len(ys))
    assert got == pytest.approx(exp, abs=1e-12)


@SETTINGS
@given(scores=vals, labels=st.lists(st.integers(0, 1), min_size=60, max_size=60))
def test_auc_equals_brute_force(spark, scores, labels):
    rows = [(float(s), labels[i]) for i, s in enumerate(scores)]
    got = A.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()["auc"]
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    if not pos or not neg:
        assert got is None
        return
    exp = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(exp, abs=1e-12)


@SETTINGS
@given(n=st.integers(20, 120), sparse=st.sampled_from([3, 10**12]), seed=st.integers(0, 10_000))
def test_group_metrics_equals_direct_definition(spark, n, sparse, seed):
    """Per kept group: the first min(n0, n1) members of each class in id order; ALL: every row."""
    import random

    import pandas as pd

    from calibrix.config import GROUPS
    from calibrix.operators import groups as G
    from calibrix.operators.losses import forecast_terms

    rnd = random.Random(seed)
    gs = GROUPS[:3]
    rows = [(i * sparse + rnd.randrange(sparse), rnd.random(), rnd.random(), rnd.random(), 0.05 + rnd.random() / 2,
             *[rnd.choice([-1.0, 0.0, 0.5, 0.75]) for _ in gs]) for i in range(n)]
    schema = "row_id long, label double, input_r double, mean double, stddev double, " + ", ".join(f"{g} double" for g in gs)
    fc = spark.createDataFrame(rows, schema)
    got = {r["group"]: r for r in G.group_metrics(fc, 0.8, groups=gs, min_size=3).collect()}
    t = forecast_terms(fc).toPandas().sort_values("row_id")
    exp = {"ALL": t}
    for g in gs:
        m = t[(t[g] != -1.0) & (t[g] >= 0.5)]
        k = min((m["target_label"] == 0).sum(), (m["target_label"] == 1).sum())
        if k >= 3:
            exp[g] = pd.concat([m[m["target_label"] == c].head(k) for c in (0, 1)])
    assert set(got) == set(exp)
    for g, part in exp.items():
        r = got[g]
        assert r["n_rows"] == len(part)
        assert r["loss_cdf"] == pytest.approx(part["cdf_gap"].mean(), abs=1e-9)
        assert r["loss_nll"] == pytest.approx(part["nll"].mean(), abs=1e-9)
        tp = int(((part["target_label"] == 1) & (part["pred_label"] == 1)).sum())
        assert r["tp"] == tp
