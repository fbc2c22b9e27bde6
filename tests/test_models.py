"""Model checks: analytic gradients vs finite differences, Spark scoring vs numpy, fitting lowers
its loss, the calibration layer's column form equals its numpy form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calibrix.operators import fitting as FT
from calibrix.operators import models as M


def _fd(f, theta, eps=1e-6, idx=None):
    idx = range(theta.size) if idx is None else idx
    out = []
    for i in idx:
        tp, tm = theta.copy(), theta.copy()
        tp[i] += eps
        tm[i] -= eps
        out.append((f(tp) - f(tm)) / (2 * eps))
    return np.array(out)


@pytest.mark.parametrize("alpha", [0.0, 0.8, 1.0])
def test_head_gradient_matches_finite_differences(alpha):
    rng = np.random.default_rng(0)
    like = M.init_head(5, hidden=7, seed=3)
    x, r, y = rng.normal(size=(20, 5)), rng.random(20), rng.random(20)
    theta = M.flatten(like)
    _, g = M.head_loss_grad(like, x, r, y, alpha)
    idx = rng.choice(theta.size, 40, replace=False)
    num = _fd(lambda t: M.head_loss_grad(M.unflatten(t, like), x, r, y, alpha)[0], theta, idx=idx)
    assert np.allclose(g[idx], num, rtol=1e-4, atol=1e-5)


def test_calibration_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    like = M.init_calibration(5)
    mean, std, q = rng.random(30), 0.1 + rng.random(30), np.linspace(0, 1, 30)
    theta = M.flatten(like)
    _, g = M.calib_loss_grad(like, mean, std, q)
    num = _fd(lambda t: M.calib_loss_grad(M.unflatten(t, like), mean, std, q)[0], theta)
    assert np.allclose(g, num, rtol=1e-4, atol=1e-6)


def _feats(spark, n=60, d=6):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=d)], int(rng.integers(0, 10))) for i in range(n)]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return M.features(emb), rows


def test_score_head_equals_numpy_forward(spark):
    feats, rows = _feats(spark)
    p = M.init_head(6, hidden=9)
    got = M.score_head(feats.repartition(3), p).toPandas().sort_values("vec_id")
    pdf = feats.toPandas().sort_values("vec_id")
    mean, std = M.head_forward(p, np.stack(pdf["x"].to_numpy()), pdf["input_r"].to_numpy())
    assert np.allclose(got["mean"].to_numpy(), mean) and np.allclose(got["stddev"].to_numpy(), std)
    assert (got["stddev"] > 0.01).all() and (got["stddev"] < 5.01).all()


def test_calibrated_columns_equal_numpy(spark):
    p = M.init_calibration(7)
    rng = np.random.default_rng(3)
    rows = [(i, float(m), float(s)) for i, (m, s) in enumerate(zip(rng.random(25), 0.05 + rng.random(25)))]
    df = spark.createDataFrame(rows, "row_id long, mean double, stddev double")
    got = M.score_calibrated(df, p).orderBy("row_id").toPandas()
    m2, s2 = M.calib_forward(p, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    assert np.allclose(got["mean"].to_numpy(), m2, atol=1e-12) and np.allclose(got["stddev"].to_numpy(), s2, atol=1e-12)


def test_dropout_gradient_and_mask():
    rng = np.random.default_rng(6)
    like = M.init_head(5, hidden=7, seed=3)
    x, r, y = rng.normal(size=(20, 5)), rng.random(20), rng.random(20)
    mask = M.dropout_mask(np.arange(20), 7, epoch=1)
    assert set(np.unique(mask)) == {0.0, 2.0} and (mask == M.dropout_mask(np.arange(20), 7, epoch=1)).all()
    assert (mask != M.dropout_mask(np.arange(20), 7, epoch=2)).any()
    assert abs((M.dropout_mask(np.arange(5000), 100, 0, 0.3) == 0).mean() - 0.3) < 0.01
    theta = M.flatten(like)
    _, g = M.head_loss_grad(like, x, r, y, 0.8, mask)
    idx = rng.choice(theta.size, 40, replace=False)
    num = _fd(lambda t: M.head_loss_grad(M.unflatten(t, like), x, r, y, 0.8, mask)[0], theta, idx=idx)
    assert np.allclose(g[idx], num, rtol=1e-4, atol=1e-5)


def test_fit_head_lowers_losses_over_the_grid(spark):
    feats, _ = _feats(spark, n=400)
    tr, ev = feats.where(F.col("vec_id") < 320), feats.where(F.col("vec_id") >= 320)
    grid = [(1e-2, 0.0), (1e-2, 0.8), (1e-3, 0.8)]
    params, log = FT.fit_head(tr, ev, grid, epochs=4, hidden=8, drop=0.2, batch_size=32)
    assert set(params) == set(grid) and len(log) <= 12
    for lr, a in grid:
        t = log[(log["learning_rate"] == lr) & (log["coefficient"] == a)]
        assert t["train_loss"].iloc[-1] < t["train_loss"].iloc[0] and params[lr, a]["best_epoch"] >= 0
    rerun, _ = FT.fit_head(tr.repartition(5), ev, grid[1:2], epochs=4, hidden=8, drop=0.2, batch_size=32)
    assert np.allclose(M.flatten(rerun[grid[1]]), M.flatten(params[grid[1]]))  # the same in any partitioning of the input
    nothing, log = FT.fit_head(tr.limit(0), ev, grid, hidden=8)
    assert len(log) == 0 and len(nothing) == 3


def test_partial_sums_over_many_tasks(spark):
    rng = np.random.default_rng(8)
    rows = [(k, t, t + 1, float(t), rng.random(6).tolist()) for k in range(2) for t in range(40)]
    got = FT.summed_partials(spark.createDataFrame(rows, FT.PARTIAL_SCHEMA), 40)
    for k in range(2):
        own = [r for r in rows if r[0] == k]
        assert got[k][:2] == (sum(r[2] for r in own), sum(r[3] for r in own)) and np.allclose(got[k][2], np.sum([r[4] for r in own], axis=0))


@pytest.mark.parametrize("tasks", [1, 3, 8])
def test_head_steps_equal_a_single_process(spark, tasks, monkeypatch):
    """The same batches taken one after the other by numpy: equal parameters for any number of tasks and blocks."""
    monkeypatch.setattr(FT, "BLOCK_ROWS", 100)
    feats, _ = _feats(spark, n=230)
    grid, epochs, size = [(1e-2, 0.0), (3e-3, 0.8)], 2, 32
    fit = FT.fit_head(feats.repartition(5), feats, grid, epochs=epochs, batch_size=size, hidden=8, drop=0.3, tasks=tasks, eval_steps=10 ** 6)
    assert len(fit[1]) == 0  # no evaluation: nothing stops, nothing is kept as best
    seen = {}
    real = FT.eval_losses
    monkeypatch.setattr(FT, "eval_losses", lambda ev, thetas, *a: seen.update(thetas) or real(ev, thetas, *a))
    FT.fit_head(feats.repartition(2), feats, grid, epochs=epochs, batch_size=size, hidden=8, drop=0.3, tasks=tasks)
    pdf = feats.withColumn("o", FT.uniform("fit_order", "vec_id")).toPandas().sort_values(["o", "vec_id"])
    like = M.init_head(6, 8)
    steps = -(-len(pdf) // size)
    for k, (lr, alpha) in enumerate(grid):
        theta = M.flatten(like)
        opt, rate = FT.Adam(theta), FT.linear_warmup_decay(lr, epochs * steps)
        for epoch in range(epochs):
            for i in range(steps):
                b = pdf.iloc[i * size:(i + 1) * size]
                mask = M.dropout_mask(b["vec_id"].to_numpy(), 8, epoch, 0.3)
                _, g = M.head_loss_grad(M.unflatten(theta, like), *FT._head_arrays(b), alpha, mask)
                theta = opt.step(theta, g / len(b), rate(epoch * steps + i))
        assert np.abs(seen[k] - theta).max() < 1e-6 and np.abs(theta - M.flatten(like)).max() > 1e-3


@pytest.mark.parametrize("tasks", [1, 3, 8])
def test_calibration_steps_equal_a_single_process(spark, tasks):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"row_id": np.arange(530), "mean": rng.random(530), "stddev": 0.1 + rng.random(530), "q": np.linspace(0, 1, 530)})
    df = spark.createDataFrame(pdf)
    got, log = FT.fit_calibration(df.repartition(6), batch_size=64, lr=0.5, epochs=2, tasks=tasks)
    b = df.withColumn("o", FT.uniform("calib_shuffle", "row_id")).toPandas().sort_values(["o", "row_id"])
    like, losses = M.init_calibration(42), []
    theta = M.flatten(like)
    for _ in range(2):
        total = 0.0
        for i in range(0, 530, 64):
            part = b.iloc[i:i + 64]
            loss, g = M.calib_loss_grad(M.unflatten(theta, like), part["mean"].to_numpy(), part["stddev"].to_numpy(), part["q"].to_numpy())
            theta, total = theta - 0.5 * g / len(part), total + loss
        losses.append(total / 530)
    assert np.abs(M.flatten(got) - theta).max() < 1e-6 and np.allclose(log["mse"], losses)


def test_steps_of_small_batches_share_jobs(spark):
    """A job takes many steps of small batches: ten times the rows take few more jobs. Large batches are dealt over tasks."""
    rng = np.random.default_rng(12)
    sc, jobs = spark.sparkContext, []
    for n in (200, 2000):
        df = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "mean": rng.random(n), "stddev": 0.1 + rng.random(n), "q": np.linspace(0, 1, n)}))
        sc.setJobGroup(f"fit-{n}", "fit")
        FT.fit_calibration(df, batch_size=10, lr=0.5)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"fit-{n}")))
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] < jobs[0] + 30  # of 180 more steps
    assert FT.dealt_over(64, FT.HEAD_TASK_ROWS) == 1 and FT.dealt_over(16_000, FT.HEAD_TASK_ROWS) == 1000


@pytest.mark.parametrize("tasks", [1, 12])
def test_steps_over_partitions_and_many_tasks(spark, tasks, monkeypatch):
    """Chains cut by partitions, blocks and evaluations, and sums of many tasks: the parameters of the steps one by one."""
    feats, _ = _feats(spark, n=230)
    grid = [(1e-2, 0.8)]
    fit = lambda t: FT.fit_head(feats, feats, grid, epochs=2, hidden=4, drop=0.3, batch_size=32, tasks=t, eval_steps=3)
    params, log = fit(3)
    for name, value in (("CHAIN_STEPS", 2), ("BLOCK_STEPS", 5), ("READ_STEPS", 2)):
        monkeypatch.setattr(FT, name, value)
    got, again = fit(tasks)
    assert np.abs(M.flatten(got[grid[0]]) - M.flatten(params[grid[0]])).max() < 1e-9 and np.allclose(log, again) and len(log) == 5


def test_evaluation_every_k_steps_stops_early(spark):
    feats, _ = _feats(spark, n=200)
    _, log = FT.fit_head(feats, feats, [(0.0, 0.8)], epochs=3, batch_size=50, hidden=4, eval_steps=2, patience=2)
    assert log["epoch"].tolist() == [0, 0, 1]  # a rate of 0 improves once, at the first evaluation


def test_fit_starts_from_the_users_parameters(spark):
    feats, _ = _feats(spark, n=100)
    own = M.init_head(6, 5, seed=77)
    params, _ = FT.fit_head(feats, feats, [(0.0, 0.8)], epochs=1, batch_size=50, init=lambda width: M.init_head(width, 5, seed=77))
    assert np.array_equal(M.flatten(params[0.0, 0.8]), M.flatten(own)) and params[0.0, 0.8]["w1"].shape == (5, 7)


def test_fit_calibration_lowers_mse(spark):
    rng = np.random.default_rng(4)
    n = 3000
    q = np.linspace(0, 1, n)
    rows = [(i, float(rng.random()), float(0.1 + rng.random()), float(q[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, mean double, stddev double, q double")
    like = M.init_calibration(42)
    pdf = df.toPandas()
    mse = lambda p: M.calib_loss_grad(p, pdf["mean"].to_numpy(), pdf["stddev"].to_numpy(), q)[0]
    fitted, log = FT.fit_calibration(df, batch_size=150, lr=0.5, epochs=3)
    assert len(log) == 3 and (log["rows"] == n).all() and mse(fitted) < mse(like)
    assert FT.fit_calibration(df.limit(0))[1].empty


def test_fits_improve_what_they_report(spark):
    import __spark_entry__ as E

    q, d = E.queries(), "/root/testdata/sf0.01"
    by = {r["stage"]: r for r in q["fit_calibration"](spark, d).collect()}
    assert by["after"]["mse"] < by["before"]["mse"] and by["after"]["n_rows"] == by["before"]["n_rows"]
    by = {r["stage"]: r for r in q["fit_score_evaluate"](spark, d).collect()}
    assert by["fitted"]["loss"] < by["initial"]["loss"]
