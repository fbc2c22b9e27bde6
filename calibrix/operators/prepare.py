"""Preparation of the labelled comment table: clean, down-sample, split, profile.

Pipeline (one lazy chain, shuffles only inside ``global_rank`` and the small count tables):
project -> null partition + sentinel -> exact stratified drop -> exact chained split -> eval/test
without nulls. Randomness is a hash of (salt, id), so counts are exact and reruns identical.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrix.config import (
    BASE_COLUMNS,
    DROP_RANGES,
    DROP_SHARES_WITH_NULLS,
    DROP_SHARES_WITHOUT_NULLS,
    GROUPS,
    HIST_BINS,
    NULL_SENTINEL,
    SPLIT_FIRST_TEST_SHARE,
    SPLIT_SECOND_TEST_SHARE,
    SPLIT_THIRD_TEST_SHARE,
    TARGET_RANGES,
)
from calibrix.functions.random import uniform
from calibrix.operators.ranking import global_rank

WITH_NULLS = "with_nulls"
WITHOUT_NULLS = "without_nulls"
SPLITS = ["train", "calib", "eval", "test"]


def fmt_bound(x: float) -> str:
    """Printed form of a range bound: integral bounds print without a decimal part."""
    return str(int(x)) if float(x).is_integer() else str(x)


def range_label(lo: float, hi: float) -> str:
    return f"[{fmt_bound(lo)}, {fmt_bound(hi)})"


# ------------------------------------------------------------------ projections and predicates
def project_columns(df: DataFrame) -> DataFrame:
    """Keep the nine groups and the base columns (pushed into the scan by column pruning)."""
    return df.select(*GROUPS, *BASE_COLUMNS)


def rename_label(df: DataFrame, label_col: str = "target") -> DataFrame:
    return df.withColumn("labels", F.col(label_col))


def any_null(groups: list[str] = GROUPS) -> Column:
    return reduce(lambda a, b: a | b, [F.col(g).isNull() for g in groups])


def null_sentinel(df: DataFrame, groups: list[str] = GROUPS) -> DataFrame:
    """If any group is null, all groups become -1.0 (known values too); adds ``stratum``."""
    flag = any_null(groups)
    others = [c for c in df.columns if c not in groups]
    return df.select(
        *others,
        *[F.when(flag, F.lit(NULL_SENTINEL)).otherwise(F.col(g)).alias(g) for g in groups],
        F.when(flag, F.lit(WITH_NULLS)).otherwise(F.lit(WITHOUT_NULLS)).alias("stratum"),
    )


def in_range(col: str, lo: float, hi: float) -> Column:
    return (F.col(col) >= F.lit(float(lo))) & (F.col(col) < F.lit(float(hi)))


def range_index(col: str, ranges) -> Column:
    """Index of the half-open range holding ``col``; null when in none (e.g. target = 1.0)."""
    expr = F.lit(None).cast("int")
    for i, (lo, hi) in reversed(list(enumerate(ranges))):
        expr = F.when(in_range(col, lo, hi), F.lit(i)).otherwise(expr)
    return expr


# ------------------------------------------------------------------ exact stratified drop
def _share_map(shares_by_stratum: dict[str, list[float]]) -> Column:
    kv = []
    for s, shares in shares_by_stratum.items():
        for i, p in enumerate(shares):
            kv += [F.lit(f"{s}:{i}"), F.lit(float(p))]
    return F.create_map(*kv)


DEFAULT_DROP_SHARES = {WITH_NULLS: DROP_SHARES_WITH_NULLS, WITHOUT_NULLS: DROP_SHARES_WITHOUT_NULLS}


KEYS = ["id", "stratum", "target"]
# A row's own key, beside its id: a digest of all its columns. Rows alike in both are copies that can stand for each other.
ROW = "_row"


def _with_row(df: DataFrame) -> DataFrame:
    nulls = F.concat(*[F.isnull(c).cast("string") for c in df.columns])  # the hash passes over nulls
    return df.withColumn(ROW, F.xxhash64(*df.columns, nulls))


def _keys(df: DataFrame) -> list[str]:
    return [*KEYS, ROW] if ROW in df.columns else KEYS


def chosen_rows(df: DataFrame, keys: DataFrame, *values: str) -> DataFrame:
    """The rows of ``df`` that ``keys`` (``KEYS``, ``ROW``, ``values``) has, with ``values``: exactly as many, also where ids repeat or
    are null: copies are collapsed to one, which joins with each of its chosen keys (one shuffle of the rows)."""
    chosen = keys.select(F.col("id").alias("_id"), F.col(ROW).alias("_key"), *values)
    rows = _with_row(df).dropDuplicates(["id", ROW])
    return rows.join(chosen, (F.col(ROW) == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))).select(*df.columns, *values)


def drop_plan(df: DataFrame, shares=None, salt: str = "drop") -> DataFrame:
    """``KEYS`` (and ``ROW``) with ``_rng``, hash position ``_pos`` in their (stratum, range) and ``_n_drop``.

    Rows outside every range (``_rng = -1``) form their own partition with ``_n_drop = 0``. Only the keys are ranked:
    texts and groups stay where they are.
    """
    shares = shares or DEFAULT_DROP_SHARES
    rng = F.coalesce(range_index("target", DROP_RANGES), F.lit(-1))
    d = df.select(*_keys(df)).withColumn("_rng", rng).withColumn("_h", uniform(salt, "id"))
    ranked = global_rank(d, "_h", "id", partition_by=["stratum", "_rng"], extra_order=_keys(df)[3:], out="_pos", total="_n")
    share = F.element_at(_share_map(shares), F.concat_ws(":", "stratum", F.col("_rng").cast("string")))
    n_drop = F.floor(F.col("_n") * F.coalesce(share, F.lit(0.0)))  # no share for range -1: 0
    return ranked.withColumn("_n_drop", n_drop.cast("bigint")).drop("_n")


def kept_keys(df: DataFrame, shares=None, salt: str = "drop") -> DataFrame:
    """``KEYS`` (and ``ROW``, if ``df`` has it) of the rows that ``stratified_drop`` keeps."""
    return drop_plan(df, shares, salt).where(F.col("_pos") > F.col("_n_drop")).select(*_keys(df))


def stratified_drop(df: DataFrame, shares=None, salt: str = "drop") -> DataFrame:
    """Drop exactly ``floor(n * share)`` rows per (stratum, target range), chosen by hash order.

    Rows whose target lies in no range (target = 1.0) are never dropped.
    """
    return chosen_rows(df, kept_keys(_with_row(df), shares, salt))


def dropped_ids(df: DataFrame, shares=None, salt: str = "drop") -> DataFrame:
    plan = drop_plan(df, shares, salt)
    return plan.where(F.col("_pos") <= F.col("_n_drop")).select("id")


# ------------------------------------------------------------------ exact chained split
def split_sizes(n: Column, first_share: Column) -> dict[str, Column]:
    """Chained train/test splits where each test part rounds up (ceil)."""
    t1 = F.ceil(n * first_share)
    t2 = F.ceil(t1 * F.lit(SPLIT_SECOND_TEST_SHARE))
    t3 = F.ceil(t2 * F.lit(SPLIT_THIRD_TEST_SHARE))
    return {"train": n - t1, "calib": t1 - t2, "eval": t2 - t3, "test": t3}


def split_keys(keys: DataFrame, salt: str = "split") -> DataFrame:
    """``KEYS`` and ``split`` in {train, calib, eval, test}, with exact sizes per stratum."""
    d = keys.select(*_keys(keys)).withColumn("_h", uniform(salt, "id"))
    first = F.create_map(*[x for k, v in SPLIT_FIRST_TEST_SHARE.items() for x in (F.lit(k), F.lit(float(v)))])
    ranked = global_rank(d, "_h", "id", partition_by=["stratum"], extra_order=_keys(keys)[3:], out="_pos", total="_n")
    sz = split_sizes(F.col("_n"), F.element_at(first, F.col("stratum")))
    c1 = sz["train"]
    c2 = c1 + sz["calib"]
    c3 = c2 + sz["eval"]
    split = (
        F.when(F.col("_pos") <= c1, "train")
        .when(F.col("_pos") <= c2, "calib")
        .when(F.col("_pos") <= c3, "eval")
        .otherwise("test")
    )
    return ranked.select(*_keys(keys), split.alias("split"))


def exact_split(df: DataFrame, salt: str = "split") -> DataFrame:
    """Add ``split`` in {train, calib, eval, test} with exact sizes per stratum."""
    return chosen_rows(df, split_keys(_with_row(df), salt), "split")


def eval_without_nulls(split_df: DataFrame) -> DataFrame:
    """Eval and test keep the no-null stratum only; the null stratum's eval/test rows are discarded."""
    return split_df.where(F.col("split").isin("train", "calib") | (F.col("stratum") == WITHOUT_NULLS))


def prepare_keys(comments_df: DataFrame) -> DataFrame:
    """``KEYS`` and ``split`` of every kept row (before the eval/test filter): the whole preparation without texts."""
    return split_keys(kept_keys(null_sentinel(project_columns(comments_df))))


def prepare(comments_df: DataFrame, texts: bool = True) -> DataFrame:
    """comments -> cleaned, down-sampled, split (all kept rows, before the eval/test filter). Texts and groups are
    joined to the split keys once, at the end; without ``texts`` these aren't read at all."""
    cleaned = null_sentinel(project_columns(comments_df))
    cleaned = cleaned if texts else cleaned.drop("comment_text")
    return chosen_rows(cleaned, split_keys(kept_keys(_with_row(cleaned))), "split")


def prepared_splits(comments_df: DataFrame, texts: bool = True) -> DataFrame:
    return eval_without_nulls(prepare(comments_df, texts))


# ------------------------------------------------------------------ profiles (A1-A4, L3)
def target_range_counts(df: DataFrame, by: list[str] | tuple = (), num_ranges_list=(2, 4)) -> DataFrame:
    """Rows per half-open target range (2 or 4 ranges); empty ranges report 0.

    One aggregation computes every range of every layout (conditional counts), then the single
    result row per ``by`` key is unpivoted.
    """
    aggs, labels = [], []
    for k in num_ranges_list:
        if k not in TARGET_RANGES:
            raise ValueError("num_ranges must be 2 or 4")
        for lo, hi in TARGET_RANGES[k]:
            name = f"c{k}_{len(labels)}"
            aggs.append(F.count(F.when(in_range("target", lo, hi), 1)).alias(name))
            labels.append((name, k, range_label(lo, hi)))
    wide = df.groupBy(*by).agg(*aggs)
    stack = F.inline(
        F.array(*[F.struct(F.lit(k).alias("num_ranges"), F.lit(lab).alias("target_range"), F.col(n).alias("n"))
                  for n, k, lab in labels])
    )
    return wide.select(*by, stack)


def sample_per_range(df: DataFrame, num_ranges: int = 2, salts=("sample1", "sample2")) -> DataFrame:
    """Two independent one-row draws per range (the same row may be drawn twice).

    ``min_by`` over the hash is a partial (map-side) aggregate: no group is ever gathered.
    """
    ranges = TARGET_RANGES[num_ranges]
    d = df.withColumn("_rng", range_index("target", ranges)).where(F.col("_rng").isNotNull())
    aggs = []
    for i, s in enumerate(salts):
        aggs.append(F.min_by(F.struct("id", "comment_text"), F.struct(uniform(s, "id"), F.col("id"))).alias(f"d{i}"))
    per = d.groupBy("_rng").agg(*aggs)
    labels = F.create_map(*[x for i, (lo, hi) in enumerate(ranges) for x in (F.lit(i), F.lit(range_label(lo, hi)))])
    draws = F.inline(F.array(*[F.struct(F.lit(i + 1).alias("draw"), F.col(f"d{i}.id").alias("id"),
                                        F.col(f"d{i}.comment_text").alias("comment_text")) for i in range(len(salts))]))
    return per.select(F.element_at(labels, F.col("_rng")).alias("target_range"), draws)


def group_value_long(df: DataFrame, keep: list[str], groups: list[str] = GROUPS) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(g).alias("group"), F.col(g).cast("double").alias("value")) for g in groups])
    return df.select(*keep, F.inline(arr))


def histogram(values: DataFrame, keys: list[str], series: list[str], value: str = "value", bins: int = HIST_BINS) -> DataFrame:
    """``keys, series, bin, n``: equal-width histograms over the joint min..max of each ``keys`` group, last bin closed.

    ``keys`` names the histogram; its ``series`` share its edges. Equal values are counted before anything is
    shuffled by key, so a histogram that holds every row costs no more than its distinct values; the edges are one row
    per histogram, a number fixed by the call's configuration, and broadcast.
    """
    per_value = values.groupBy(*keys, *series, value).agg(F.count(F.lit(1)).alias("_n"))
    rng = per_value.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    rng = rng.select(
        *keys,
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    j = per_value.join(F.broadcast(rng), keys, "inner")
    b = F.least(F.floor((F.col(value) - F.col("_lo")) * (F.lit(float(bins)) / (F.col("_hi") - F.col("_lo")))),
                F.lit(bins - 1))
    return j.groupBy(*keys, *series, b.cast("bigint").alias("bin")).agg(F.sum("_n").alias("n"))
