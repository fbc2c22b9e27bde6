"""Writes that count once, kept partial results, the user's metrics, co-located joins."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calibrix.config import fresh_path
from calibrix.operators import callbacks as CB
from calibrix.operators import partials as PA
from calibrix.operators import prepare as P
from calibrix.sources import commits as C
from calibrix.sources import files as FS
from calibrix.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def test_an_append_that_is_repeated_or_dies(spark):
    path, df = fresh_path(spark, "test_once"), spark.range(10)
    assert C.read_committed(spark, path, df.schema).count() == 0
    assert C.append_once(df, path, "a") and not C.append_once(df, path, "a")
    df.write.parquet(C.part_path(path, "died"))  # a writer that ended before its record
    assert C.read_committed(spark, path, df.schema).count() == 10
    assert C.append_once(df, path, "b")
    assert C.read_committed(spark, path, df.schema).count() == 20


def test_two_writers_of_one_key(spark):
    """Both fill a part before either is recorded: the first record holds, the second part is never read."""
    path = fresh_path(spark, "test_race")
    for part, rows in (("one", 3), ("two", 5)):
        spark.range(rows).write.parquet(C.part_path(path, part))
    assert C.commit(spark, path, "k", "one")["part"] == "one"
    assert C.commit(spark, path, "k", "two")["part"] == "one"
    assert C.read_committed(spark, path, spark.range(1).schema).count() == 3


def test_two_builders_at_once(spark):
    path, calls = fresh_path(spark, "test_build"), []

    def build():
        calls.append(1)
        if len(calls) == 1:  # while the first builds, another builds and publishes
            assert FS.materialize(spark, path, build).count() == 102
        return spark.range(100 + len(calls))

    assert FS.materialize(spark, path, build).count() == 102
    assert FS.materialize(spark, path, build).count() == 102 and len(calls) == 2


def _forecast_files(spark, path, parts, mode="append"):
    FX.predictions(spark, SF).where(F.pmod(F.xxhash64("row_id"), F.lit(4)).isin(*parts)).repartition(6).write.mode(mode).parquet(path)


def test_interrupted_and_incremental_evaluation(spark):
    source, store = fresh_path(spark, "test_files"), fresh_path(spark, "test_store")
    schema, read = FX.predictions(spark, SF).schema, []

    def statistics(df):
        read.append(len(df.inputFiles()))
        if sum(read) > 4 and len(read) == 3:
            raise RuntimeError("lost")
        return PA.loss_statistics(df)

    _forecast_files(spark, source, [0, 1])
    with pytest.raises(RuntimeError):
        PA.flush_partials(spark, source, store, statistics, files_per_flush=2, schema=schema)
    assert read == [2, 2, 2]
    assert PA.flush_partials(spark, source, store, statistics, files_per_flush=2, schema=schema) == 1 and read[3:] == [2]
    _forecast_files(spark, source, [2, 3])
    assert PA.flush_partials(spark, source, store, statistics, files_per_flush=4, schema=schema) == 2 and sum(read[4:]) == 6
    assert PA.flush_partials(spark, source, store, statistics, schema=schema) == 0
    exp = PA.loss_statistics(FX.predictions(spark, SF)).toPandas().set_index("group").sort_index()
    got = PA.final_losses(spark, store).toPandas().set_index("group").sort_index()
    assert (got["n"] == exp["n"]).all() and np.allclose(got["loss_nll"], exp["s_nll"] / exp["n"]) and np.allclose(got["loss_cdf"], exp["s_cdf"] / exp["n"])


def longest_name():
    """A metric whose state is a text: the longest name (the first of those)."""

    class Longest:
        columns = ["name"]

        def start(self):
            return ""

        def update(self, state, rows):
            return self.merge(state, min(rows["name"].dropna(), key=lambda x: (-len(x), x), default=""))

        def merge(self, a, b):
            return min((a, b), key=lambda x: (-len(x), x))

        def finish(self, state):
            return {"longest": len(state)}

    return Longest()


def test_metrics_of_skewed_groups(spark):
    """Nine rows in ten in one group, over many tasks; a null group; each state is merged, not the rows."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": ["hot"] * 4500 + ["b"] * 300 + [None] * 200, "x": rng.normal(1e6, 1, 5000), "name": ["n" * int(k) for k in rng.integers(0, 60, 5000)]})
    pdf["target_label"], pdf["pred_label"] = rng.integers(0, 2, 5000), rng.integers(0, 2, 5000)
    df = spark.createDataFrame(pdf).repartition(13)
    rows = CB.aggregate_metrics(df, ["g"], [CB.Spread("x"), longest_name(), CB.BalancedAccuracy()]).collect()
    got = {(r.g, r.metric): r.value for r in rows}
    assert len(got) == len(rows) == 12
    for g, part in pdf.groupby("g", dropna=False):
        g = None if pd.isna(g) else g
        assert math.isclose(got[g, "x_mean"], part["x"].mean()) and math.isclose(got[g, "x_spread"], part["x"].std(ddof=0), rel_tol=1e-6)
        assert got[g, "longest"] == part["name"].str.len().max()
        right = [(part["pred_label"][part["target_label"] == t] == t).mean() for t in (0, 1)]
        assert math.isclose(got[g, "balanced_accuracy"], sum(right) / 2)
    assert CB.aggregate_metrics(df.where("1 = 0"), ["g"], [CB.Spread("x")]).collect() == []


def test_bucketed_tables_join_without_a_shuffle(spark):
    a = FS.write_bucketed(spark.range(500).withColumn("x", F.col("id") * 2), "test_left", "id", 4)
    b = FS.write_bucketed(spark.range(0, 500, 3).withColumn("y", F.col("id") + 1), "test_right", "id", 4)
    j = a.hint("merge").join(b, "id")
    plan = j._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert j.count() == 167


def test_repeated_and_null_ids_keep_exact_counts(spark):
    """Each id twice (once as an exact copy, else with another text), null ids too: as many rows as the ranks chose."""
    rows = [(i // 2 if i < 190 else None, "a" if i % 4 < 2 else str(i), (i % 20) / 20, "with_nulls" if i % 3 else "without_nulls") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, comment_text string, target double, stratum string")
    kept, plan = P.stratified_drop(df), P.drop_plan(df)
    assert kept.count() == plan.where("_pos > _n_drop").count() < 200
    assert kept.columns == df.columns and not Counter(map(tuple, kept.collect())) - Counter(rows)
    split = P.exact_split(df)
    assert Counter(map(tuple, split.drop("split").collect())) == Counter(rows)
    sizes = {(r.stratum, r.split): r["count"] for r in split.groupBy("stratum", "split").count().collect()}
    for stratum in ("with_nulls", "without_nulls"):
        n = sum(r[3] == stratum for r in rows)
        t1 = math.ceil(n * P.SPLIT_FIRST_TEST_SHARE[stratum])
        t2 = math.ceil(t1 * P.SPLIT_SECOND_TEST_SHARE)
        t3 = math.ceil(t2 * P.SPLIT_THIRD_TEST_SHARE)
        assert [sizes.get((stratum, s), 0) for s in ("train", "calib", "eval", "test")] == [n - t1, t1 - t2, t2 - t3, t3]
