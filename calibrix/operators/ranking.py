"""Exact global order statistics without a single-partition window.

``Window.orderBy(...)`` with no partition key sends every row to one task. Here the rows are range-partitioned
on the whole sort key (partition columns, key, id) and sorted in their partitions: Spark samples the cut points
from the data itself, so clustered keys, sparse ids and hot values (split by their ids) spread evenly over
``spark.sql.shuffle.partitions`` tasks at any size of input. The sorted rows are written once with their number
in their partition; a row's rank is that number plus the rows of the partitions before, which come from a table
of one row per partition (and partition key).

The write is a job of its own, run while the plan is built: the cut points must be the same for the offsets and
for the ranks, so the order is fixed by materialising it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibrix.sources.files import written

_AT = "_rk_at"
_SLICE = "_rk_slice"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` in the global order of ``keys``, written once; ``_rk_slice`` and ``_rk_at`` are a row's partition and
    its place (increasing over all rows, without gaps inside a partition). The partition count is given, so that
    adaptive execution doesn't merge the partitions of a small input and every size runs the same plan."""
    n = shuffle_partitions(df.sparkSession)
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(_AT, F.monotonically_increasing_id())
    return written(rows, "ordered").withColumn(_SLICE, F.shiftright(F.col(_AT), 33))


def _with_offsets(rows: DataFrame, offsets: DataFrame, part: list[str]) -> DataFrame:
    """Equi-join on the partition keys (null-safe: null is a partition too) and slices; the offsets have a row per
    partition key and slice, so Spark broadcasts them unless there are very many keys."""
    ren = {c: f"_rk_j{i}" for i, c in enumerate([*part, _SLICE])}
    o = offsets.select(*[F.col(c).alias(ren.get(c, c)) for c in offsets.columns])
    cond = [F.col(c).eqNullSafe(F.col(ren[c])) for c in part] + [F.col(_SLICE) == F.col(ren[_SLICE])]
    return rows.join(o, cond, "inner").drop(*ren.values())


def global_rank(df: DataFrame, key: str, id_col: str, partition_by: list[str] | tuple = (), out: str = "rank",
                extra_order: list[str] | tuple = (), total: str | None = None) -> DataFrame:
    """1-based position of each row in ``(key, id, *extra_order)`` order within ``partition_by``.

    Exact: ties are broken by ``id``, then ``extra_order``. ``total`` names an optional column with the row count of
    the row's partition. All columns of ``df`` are sorted and written; pass narrow rows and join the rest back.
    """
    part = list(partition_by)
    order = [c for c in dict.fromkeys([key, id_col, *extra_order]) if c not in part]
    rows = ordered(df, [*part, *order])
    counts = rows.groupBy(*part, _SLICE).agg(F.count(F.lit(1)).alias("_rk_n"), F.min(_AT).alias("_rk_first"))
    before = Window.partitionBy(*part).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_rk_n").over(Window.partitionBy(*part)).alias(total)] if total else []
    offsets = counts.select(*part, _SLICE, (F.coalesce(F.sum("_rk_n").over(before), F.lit(0)) - F.col("_rk_first") + 1).alias("_rk_off"), *extra)
    ranked = _with_offsets(rows, offsets, part)
    return ranked.withColumn(out, (F.col(_AT) + F.col("_rk_off")).cast("bigint")).drop("_rk_off", _AT, _SLICE)


def prefix_sum(df: DataFrame, key: str, sum_cols: list[str], partition_by: list[str] | tuple = (), strict: bool = True,
               suffix: str = "_below") -> DataFrame:
    """Running sums of ``sum_cols`` in ``key`` order within ``partition_by``.

    ``key`` must be unique inside a partition (callers group by the key first). ``strict=True`` gives sums over rows
    strictly below the current key; otherwise up to and including it.
    """
    part = list(partition_by)
    rows = ordered(df, [*part, key])
    tot = rows.groupBy(*part, _SLICE).agg(*[F.sum(c).alias(f"_ps_{c}") for c in sum_cols])
    before = Window.partitionBy(*part).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tot.select(*part, _SLICE, *[F.coalesce(F.sum(f"_ps_{c}").over(before), F.lit(0)).alias(f"_po_{c}") for c in sum_cols])
    within = Window.partitionBy(*part, _SLICE).orderBy(_AT).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    j = _with_offsets(rows, offsets, part)
    sums = [(F.col(f"_po_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}{suffix}") for c in sum_cols]
    return j.select("*", *sums).drop(*[f"_po_{c}" for c in sum_cols], _AT, _SLICE)


def cut_points(df: DataFrame, col: str, parts: int | None = None) -> list:
    """At most ``parts - 1`` values of a numeric column that cut its rows into about equal parts (approximate
    quantiles; by default four parts per shuffle partition). Runs one aggregate; the result is bounded by ``parts``."""
    parts = parts or 4 * shuffle_partitions(df.sparkSession)
    probs = [i / parts for i in range(1, parts)]
    got = df.agg(F.percentile_approx(col, probs, max(10_000, 10 * parts))).first()[0] if probs else None
    return sorted(set(got or []))


def cut_index(col: str, cuts: list) -> Column:
    """Number of cut points below a value: found among every k-th cut first, then between two of those."""
    if not cuts:
        return F.lit(0)
    k = max(1, int(len(cuts) ** 0.5))
    fine, coarse = F.array(*[F.lit(c) for c in cuts]), F.array(*[F.lit(c) for c in cuts[k - 1::k]])
    block = F.size(F.filter(coarse, lambda c: c < F.col(col)))
    return F.element_at(F.transform(F.array(block), lambda b: b * k + F.size(F.filter(
        F.slice(fine, b * k + 1, F.lit(k)), lambda c: c < F.col(col)))), 1)
