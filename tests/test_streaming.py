"""Streams: in-order file source gives the batch answer on closed windows; a newest-first source
loses late rows in append mode; patience state equals the batch early stop."""

import os
import time
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calibrix.operators import runs as R
from calibrix.sources import fixtures as FX
from calibrix.config import fresh_path
from calibrix.sources.tables import read_table
from calibrix.streaming import group_loss as SG
from calibrix.streaming import patience as SP
from calibrix.streaming.sources import stage_in_order

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _append_run(spark, reverse):
    d = fresh_path(spark, "test_t1")
    ev = read_table(spark, SF, "events", ["event_id", "ts", "value"]).withColumn("ts", F.col("ts").cast("timestamp"))
    stage_in_order(ev, f"{d}/source", "ts", files=10, reverse=reverse)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/source")
    drops = SG.WatermarkDrops()
    spark.streams.addListener(drops)
    q = SG.stream_group_loss(FX.forecasts_from_events(stream, keep_ts=True), f"{d}/out", f"{d}/ckpt", mode="append")
    q.awaitTermination()
    for _ in range(100):  # reports come a little later
        if drops.total or not reverse:
            break
        time.sleep(0.1)
    spark.streams.removeListener(drops)
    out = spark.read.parquet(f"{d}/out").where(F.col("group") == "ALL")
    _append_run.drops = drops.total
    ev = ev.join(FX.predictions(spark, SF).where("label is not null").select(F.col("row_id").alias("event_id")), "event_id")
    return {r["window_start"]: r["n_rows"] for r in out.collect()}, ev


def test_append_in_order_matches_batch_on_closed_windows(spark):
    got, ev = _append_run(spark, reverse=False)
    batch = {r["d"]: r["n"] for r in ev.groupBy(F.window("ts", "1 day").start.alias("d")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert got, "closed windows were emitted"
    assert len(got) < len(batch)  # the last windows stay open at the end of availableNow
    for day, n in got.items():
        assert batch[day] == n


def test_append_out_of_order_drops_late_rows(spark):
    in_order, ev = _append_run(spark, reverse=False)
    assert _append_run.drops == 0
    late, _ = _append_run(spark, reverse=True)
    assert sum(late.values()) < sum(in_order.values())
    assert _append_run.drops > 0  # reported by the state operator


def _staged_log(spark, d, order, log=None, files=10):
    log = SP.numbered(FX.eval_log(spark, SF) if log is None else log)
    staged = log.withColumn("ts", F.to_timestamp(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("step").cast("int"))))
    stage_in_order(staged.withColumn("_o", order), f"{d}/source", "_o", files=files)
    return spark.readStream.schema(staged.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/source")


def _status(spark, d):
    return {r["run_id"]: tuple(r) for r in SP.latest_status(spark, f"{d}/out").collect()}


def _batch_answer(log):
    return {r["run_id"]: tuple(r) for r in R.early_stop(log, 3).select(*SP.STATUS_SCHEMA_COLS).collect()}


@pytest.mark.parametrize("delivery", ["in order", "shuffled", "backwards"])
def test_stream_early_stop_equals_batch(spark, delivery):
    d = fresh_path(spark, "test_t2")
    order = {"in order": F.col("step"), "shuffled": F.xxhash64("run_id", "step"), "backwards": -F.col("step")}[delivery]
    SP.stream_early_stop(_staged_log(spark, d, order), f"{d}/out", f"{d}/ckpt", patience=3, wait="400 days").awaitTermination()
    assert _status(spark, d) == _batch_answer(FX.eval_log(spark, SF))


def test_stream_early_stop_goes_on_from_its_checkpoint(spark):
    """Half of the files, a new query on the same checkpoint for the other half, and every file delivered a second time."""
    d, log = fresh_path(spark, "test_t2_restart"), FX.eval_log(spark, SF)
    shuffled = F.xxhash64("run_id", "step")
    parts = [log.where(F.pmod(shuffled, F.lit(2)) == k) for k in (0, 1)]
    whole = SP.numbered(log).withColumn("ts", F.to_timestamp(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("step").cast("int"))))
    for part in (*parts, log):
        whole.join(part.select("run_id", "step"), ["run_id", "step"]).write.mode("append").parquet(f"{d}/source")
        stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 2).parquet(f"{d}/source")
        SP.stream_early_stop(stream, f"{d}/out", f"{d}/ckpt", patience=3, wait="400 days").awaitTermination()
    assert _status(spark, d) == _batch_answer(log)


def test_state_of_a_run_ends(spark):
    """Far behind the watermark a run's state is removed; a gap that isn't filled is passed over."""
    d = fresh_path(spark, "test_t2_ttl")
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    rows = [("a", k, k, 1.0 / k, day(k)) for k in range(1, 6)] + [("b", k, k, 1.0, day(k)) for k in (1, 3, 4)] + [("c", 1, 1, 1.0, day(90)), ("c", 2, 2, 1.0, day(200))]
    for k, part in enumerate((rows[:8], rows[8:9], rows[9:])):
        df = spark.createDataFrame(part, "run_id string, eval_no long, step long, eval_loss double, ts timestamp")
        df.coalesce(1).write.mode("append").parquet(f"{d}/source")
        stream = spark.readStream.schema(df.schema).parquet(f"{d}/source")
        q = SP.stream_early_stop(stream, f"{d}/out", f"{d}/ckpt", patience=3, wait="10 days")
        q.awaitTermination()
    last = spark.read.parquet(f"{d}/out").groupBy("run_id").agg(F.max("n_evals").alias("n"), F.max("n_missing").alias("m"))
    assert {tuple(r) for r in last.collect()} == {("a", 5, 0), ("b", 3, 1), ("c", 2, 0)}
    assert _status(spark, d)["b"][1:] == (3, None, 1.0, 1)


@pytest.mark.parametrize("seed", range(3))
def test_patience_summary_in_pieces(seed):
    """A run's evaluations taken in pieces of any size: as a loop over all of its steps."""
    import random

    rnd = random.Random(seed)
    for _ in range(100):
        losses = [rnd.choice([0.9, 0.7, 0.5, 0.3, float("nan"), rnd.random()]) for _ in range(rnd.randrange(1, 14))]
        s, lo = SP.Summary(), 0
        while lo < len(losses):
            hi = lo + rnd.randrange(1, 5)
            s.take(np.arange(lo, min(hi, len(losses))), np.array(losses[lo:hi]), 3)
            lo = hi
        best, best_step, bad, stop = None, None, 0, None
        for i, x in enumerate(losses):
            if x < (best if best is not None else float("inf")):
                best, best_step, bad = x, i, 0
            else:
                bad += 1
            if bad >= 3:
                stop = i
                break
        got = s.status("r", 0).iloc[0]
        none = lambda v: None if pd.isna(v) else v
        assert (none(got["stop_step"]), none(got["best_loss"]), none(got["best_step"])) == (stop, best, best_step) and got["n_evals"] == len(losses)


def test_evaluations_without_a_loss(spark):
    """Null and NaN losses improve nothing: the batch and the stream agree."""
    nan = float("nan")
    runs = {"none": [None] * 6, "late": [None, 5.0, 6.0, 6.0, 6.0], "nan": [nan, nan, 4.0, None, 3.0, nan, None, nan, 1.0], "first": [2.0, None, nan, None]}
    log = spark.createDataFrame([(r, i, x) for r, xs in runs.items() for i, x in enumerate(xs)], "run_id string, step long, eval_loss double")
    exp = {"none": ("none", 6, 2, None, None), "late": ("late", 5, 4, 5.0, 1), "nan": ("nan", 9, 7, 3.0, 4), "first": ("first", 4, 3, 2.0, 0)}
    assert _batch_answer(log) == exp
    assert {r["run_id"]: r["best_step"] for r in R.patience_trace(log).orderBy("step").collect()} == {"none": None, "late": 1, "nan": 8, "first": 0}
    d = fresh_path(spark, "test_t2_nulls")
    SP.stream_early_stop(_staged_log(spark, d, -F.col("step"), log, 3), f"{d}/out", f"{d}/ckpt", patience=3, wait="400 days").awaitTermination()
    assert _status(spark, d) == exp


def test_update_mode_state_is_bounded_and_complete(spark):
    """Every window's last update equals the batch answer, and closed windows leave the state store."""
    d = fresh_path(spark, "test_t1_update")
    ev = read_table(spark, SF, "events", ["event_id", "ts", "value"]).withColumn("ts", F.col("ts").cast("timestamp"))
    stage_in_order(ev, f"{d}/source", "ts", files=10)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/source")
    q = SG.stream_group_loss(FX.forecasts_from_events(stream, keep_ts=True), f"{d}/out", f"{d}/ckpt")
    q.awaitTermination()
    got = {(r["window_start"], r["group"]): r["n_rows"] for r in SG.latest_sums(spark, f"{d}/out").collect()}
    batch = SG.window_sums(FX.forecasts_from_events(ev, keep_ts=True), watermark=None)
    assert got == {(r["window_start"], r["group"]): r["n_rows"] for r in batch.collect()}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < len(got) / 2


def test_redelivered_events_count_once(spark):
    """Every file delivered twice: the batch answer, and the ids of passed events leave the state."""
    d = fresh_path(spark, "test_t1_twice")
    ev = read_table(spark, SF, "events", ["event_id", "ts", "value"]).withColumn("ts", F.col("ts").cast("timestamp"))
    stage_in_order(ev.unionByName(ev), f"{d}/source", "ts", files=10)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/source")
    q = SG.stream_group_loss(FX.forecasts_from_events(stream, keep_ts=True), f"{d}/out", f"{d}/ckpt", event_id="row_id")
    q.awaitTermination()
    got = {(r["window_start"], r["group"]): r["n_rows"] for r in SG.latest_sums(spark, f"{d}/out").collect()}
    batch = SG.window_sums(FX.forecasts_from_events(ev, keep_ts=True), watermark=None)
    assert got == {(r["window_start"], r["group"]): r["n_rows"] for r in batch.collect()}
    ids = [op for op in q.lastProgress["stateOperators"] if "dedupe" in op["operatorName"].lower()][0]
    assert ids["numRowsTotal"] < ev.count() / 2
