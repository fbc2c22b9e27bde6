"""Plan properties that matter at scale: scans read only the needed columns, split reads prune
partitions, SQL-expressible queries stay in the JVM, ranks never use an unpartitioned window on
data rows."""

import os
import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _schemas(plan: str) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for table, schema in re.findall(r"Location: [^\]]*?/(\w+)\.parquet\].*?ReadSchema: struct<([^>]*)>", plan):
        out.setdefault(table, set()).update(f.split(":")[0] for f in schema.split(",") if f)
    return out


@pytest.mark.parametrize("name,table,allowed", [
    ("histogram_30", "documents", {"doc_id"}),
    ("null_sentinel", "documents", {"doc_id"}),
    ("alpha_sweep", "events", {"event_id", "value"}),  # group metrics write the same terms, in a job before
    ("early_stop", "events", {"ts", "event_type", "value"}),
])
def test_scans_read_only_needed_columns(spark, name, table, allowed):
    got = _schemas(_plan(E.queries()[name](spark, SF)))
    assert table in got and got[table] <= allowed, got


@pytest.mark.parametrize("name", ["group_metrics", "exact_split", "stratified_drop", "pit_rank", "auc_full",
                                  "pairwise_gap", "histogram_30", "vocab_lookup", "tradeoff_points"])
def test_sql_expressible_queries_stay_in_the_jvm(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert not re.search(r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", plan)


@pytest.mark.parametrize("name", ["pit_rank", "batch_index", "auc_full", "exact_split", "vocab_lookup"])
def test_no_window_over_all_rows(spark, name):
    """Only the offsets (a row per range) may meet in one task: every window with rows of data has a partition key."""
    plan = _plan(E.queries()[name](spark, SF))
    for line in plan.splitlines():
        if "Window [" in line and "_rk_slice" not in line.split("specifiedwindowframe")[0] and "_rk_n" not in line and "_ps_" not in line:
            raise AssertionError(line)


def test_split_read_prunes_partitions(spark):
    plan = _plan(E.queries()["scan_splits"](spark, SF))
    assert re.search(r"PartitionFilters: \[[^\]]*split", plan)


def test_file_queries_dont_disturb_each_other(spark):
    """All are built first, then read: none overwrites another's files."""
    names = ["scan_comments", "write_splits", "scan_splits", "cached_dataset", "metric_point_append", "metric_log"]
    built = {n: E.queries()[n](spark, SF) for n in [*names, *names]}
    first = {n: df.count() for n, df in built.items()}
    assert all(first.values()) and first == {n: E.queries()[n](spark, SF).count() for n in names}


def test_cache_key_follows_the_input_files(spark, tmp_path):
    from calibrix.sources.files import input_listing

    spark.range(5).write.parquet(f"{tmp_path}/t.parquet")
    a = input_listing(spark, f"{tmp_path}/t.parquet")
    assert a == input_listing(spark, f"{tmp_path}/t.parquet")
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert a != input_listing(spark, f"{tmp_path}/t.parquet")


def test_written_table_round_trips_under_the_checkpoint_folder(spark):
    from calibrix.config import checkpoint_root
    from calibrix.sources.files import written

    df = spark.range(0, 50).selectExpr("id", "id * 2 AS v")
    w = written(df, "test_written")
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, df.collect()))
    def local(uri: str) -> str:
        return re.sub(r"^file:/*", "/", uri)

    root = local(checkpoint_root(spark))
    assert all(local(f).startswith(root) for f in w.inputFiles())
