"""Per-group evaluation: membership, class-balanced subsets, confusion counts and metrics.

All nine groups are handled in one pass: each forecast row emits one ``(group, value)`` row per
group it is a member of (``inline(filter(array(...)))``, no 9x blow-up of non-members), then one
aggregate groups by ``group``. The balanced subset takes the first ``min(n0, n1)`` members of
each class in ``row_id`` order via ``global_rank`` (a huge group is spread over the ranges of its ids).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrix.config import DEFAULT_COEFFICIENT, GROUPS, MIN_GROUP_SIZE, NULL_SENTINEL, OVERALL
from calibrix.operators.losses import forecast_terms
from calibrix.operators.ranking import cut_index, cut_points, global_rank
from calibrix.sources.files import written


def member_condition(value) -> "F.Column":
    """In a group iff the score is known (not the sentinel) and >= 0.5; null is not a member."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce((v != F.lit(NULL_SENTINEL)) & (v >= F.lit(0.5)), F.lit(False))


def group_members(df: DataFrame, groups: list[str] = GROUPS, keep: list[str] | None = None) -> DataFrame:
    """Long form: one row per (row, group it belongs to) with ``group`` and ``gval`` columns."""
    keep = [c for c in df.columns if c not in groups] if keep is None else keep
    arr = F.array(*[F.struct(F.lit(g).alias("group"), F.col(g).cast("double").alias("gval")) for g in groups])
    return df.select(*keep, F.inline(F.filter(arr, lambda s: member_condition(s["gval"]))))


def with_scopes(df: DataFrame, keep: list[str], groups: list[str] = GROUPS) -> DataFrame:
    """``keep`` columns plus ``group``: each row once as ``ALL`` and once per member group, in one
    pass (``explode`` of a filtered array; no union that would derive ``df`` twice)."""
    items = [F.lit(OVERALL)] + [F.when(member_condition(g), F.lit(g)) for g in groups]
    return df.select(*keep, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("group"))


def class_counts(members: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Per group: members of class 0 and class 1 (by ``target_label``)."""
    return members.groupBy(*by, "group").agg(
        F.count(F.when(F.col("target_label") == 0, 1)).alias("zeros"),
        F.count(F.when(F.col("target_label") == 1, 1)).alias("ones"),
    )


def group_sizes(members: DataFrame, min_size: int = MIN_GROUP_SIZE, by: list[str] | tuple = ()) -> DataFrame:
    """``group, n0, n1, group_size = min(n0, n1), kept = group_size >= min_size``."""
    cc = class_counts(members, by)
    return cc.select(
        *by,
        "group",
        F.col("zeros").alias("n0"),
        F.col("ones").alias("n1"),
        F.least("zeros", "ones").alias("group_size"),
        (F.least("zeros", "ones") >= F.lit(min_size)).alias("kept"),
    )


def balanced_members(
    members: DataFrame, min_size: int = MIN_GROUP_SIZE, id_col: str = "row_id", by: list[str] | tuple = ()
) -> DataFrame:
    """The first ``group_size`` rows of each class per kept group, in ``id_col`` order.

    Without outer keys the size table has one row per group column (at most nine), so it is
    broadcast explicitly; with outer keys (runs) its size grows with them and AQE picks the join
    from the runtime size.
    """
    by = list(by)
    sizes = group_sizes(members, min_size, by).where("kept").select(*by, "group", "group_size")
    m = members.join(sizes if by else F.broadcast(sizes), [*by, "group"], "inner")
    ranked = global_rank(m, id_col, id_col, partition_by=[*by, "group", "target_label"], out="_class_pos")
    return ranked.where(F.col("_class_pos") <= F.col("group_size")).drop("_class_pos")


def confusion_aggs() -> list:
    p, t = F.col("pred_label"), F.col("target_label")
    return [
        F.count(F.when((t == 0) & (p == 0), 1)).alias("tn"),
        F.count(F.when((t == 0) & (p == 1), 1)).alias("fp"),
        F.count(F.when((t == 1) & (p == 0), 1)).alias("fn"),
        F.count(F.when((t == 1) & (p == 1), 1)).alias("tp"),
    ]


def classification_columns(tn="tn", fp="fp", fn="fn", tp="tp") -> list:
    """FPR, Recall, Accuracy, Precision, F1 from counts; a zero denominator gives 0."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in (tn, fp, fn, tp))
    fpr = F.when(fp + tn > 0, fp / (fp + tn)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    acc = (tp + tn) / (tp + tn + fp + fn)
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, F.lit(2.0) * (prec * rec) / (prec + rec)).otherwise(F.lit(0.0))
    return [rec.alias("Recall"), fpr.alias("FPR"), prec.alias("Precision"), f1.alias("F1"), acc.alias("Accuracy")]


def _sufficient_aggs() -> list:
    """Additive per-row statistics from which every metric of a set of rows is finished."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum("cdf_gap").alias("s_cdf"),
        F.sum("nll").alias("s_nll"),
        F.sum("stddev").alias("s_std"),
        *confusion_aggs(),
    ]


_STAT_COLS = ["n", "s_cdf", "s_nll", "s_std", "tn", "fp", "fn", "tp"]


def _sum_stats(df: DataFrame, by: list) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in _STAT_COLS])


def _finish_metrics(stats: DataFrame, coefficient: float) -> DataFrame:
    n = F.col("n").cast("double")
    cdf, nll = F.col("s_cdf") / n, F.col("s_nll") / n
    return stats.select(
        "*",
        F.col("n").alias("n_rows"),
        (F.lit(1.0 - coefficient) * cdf + F.lit(coefficient) * nll).alias("loss"),
        cdf.alias("loss_cdf"),
        (F.col("s_std") / n).alias("loss_stddev"),
        nll.alias("loss_nll"),
        *classification_columns(),
    )


def group_metrics(
    fc: DataFrame,
    coefficient: float = DEFAULT_COEFFICIENT,
    groups: list[str] = GROUPS,
    min_size: int = MIN_GROUP_SIZE,
    use_sample: bool = False,
    by: list[str] | tuple = (),
    id_col: str = "row_id",
) -> DataFrame:
    """Wide metric table: one row per kept group (balanced subset) plus the ``ALL`` row (whole
    table, unbalanced). ``by`` adds outer keys (e.g. a run id) to every aggregate.

    The forecasts are read once: their narrow terms (keys, id, labels, three numbers, a bit per group) are written, and the
    cut points and both passes read those. Only boundary rows are shuffled:

    1. every row is emitted once for ``ALL`` and once per member group, tagged with its id block
       (ranges between quantiles of the ids, so sparse or hashed ids do as well as dense ones), and aggregated
       to additive statistics per ``(group, class, block)``: a table of groups x 2 x blocks rows. Class sizes, the ``ALL``
       row, per-block offsets and the statistics of every block that lies wholly inside the
       balanced subset (the first ``min(n0, n1)`` rows of each class in id order) come from it.
    2. only rows of the one block per (group, class) that straddles the cut are ranked (inside
       that block, a few rows in a thousand of one group and class per task) and added to the full blocks.
    """
    by = list(by)
    cols = [*by, id_col, "target_label", "pred_label", "cdf_gap", "nll", "stddev"]
    member = [F.when(member_condition(g), F.lit(1 << i)).otherwise(F.lit(0)) for i, g in enumerate(groups)]
    t = forecast_terms(fc, use_sample=use_sample).select(*cols, reduce(lambda a, b: a.bitwiseOR(b), member, F.lit(0)).alias("_in"))
    t = written(t, "forecast_terms")
    # The block is found once per row, before the row is repeated for its groups.
    t = t.withColumn("_blk", cut_index(id_col, cut_points(t, id_col)))
    scopes = [F.lit(OVERALL)] + [F.when(F.col("_in").bitwiseAND(1 << i) != 0, F.lit(g)) for i, g in enumerate(groups)]
    e = t.select(*cols, "_blk", F.explode(F.filter(F.array(*scopes), lambda x: x.isNotNull())).alias("group"))
    per_block = e.groupBy(*by, "group", "target_label", "_blk").agg(*_sufficient_aggs())

    # Sizes and block offsets by windows over the small per-block table, then ONE aggregate per
    # (group) gives: the statistics of the blocks wholly inside the subset (all blocks for ALL),
    # and, per class, the straddling block and how many of its rows are still needed. Every later
    # use reads this one result, so its plan is shared rather than re-derived per branch.
    lab = F.col("target_label")
    wg = Window.partitionBy(*by, "group")
    wc = Window.partitionBy(*by, "group", "target_label").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    pb = per_block.select(
        "*",
        F.sum(F.when(lab == 0, F.col("n")).otherwise(0)).over(wg).alias("_n0"),
        F.sum(F.when(lab == 1, F.col("n")).otherwise(0)).over(wg).alias("_n1"),
        F.coalesce(F.sum("n").over(wc), F.lit(0)).alias("_off"),
    )
    is_all = F.col("group") == OVERALL
    k = F.least("_n0", "_n1")
    full = is_all | (F.col("_off") + F.col("n") <= k)
    edge = ~is_all & (F.col("_off") < k) & (F.col("_off") + F.col("n") > k)
    res = pb.withColumn("_need", k - F.col("_off")).groupBy(*by, "group").agg(
        F.when(F.first(is_all), F.lit(None)).otherwise(F.first(k)).cast("bigint").alias("group_size"),
        *[F.coalesce(F.sum(F.when(full, F.col(c))), F.lit(0)).alias(c) for c in _STAT_COLS],
        *[F.max(F.when(edge & (lab == c), F.col(x))).alias(f"{x}{c}") for c in (0, 1) for x in ("_blk", "_need")],
    )
    res = res.where(F.col("group_size").isNull() | (F.col("group_size") >= min_size))
    # A few rows per outer key; written once so both uses below read it instead of re-deriving it.
    res = written(res, "group_metrics_blocks")

    # Pass 2: rows of the straddling blocks only (at most 2 per group), ranked inside the block.
    edges = res.select(*by, "group", F.inline(F.array(*[
        F.struct(F.lit(c).alias("target_label"), F.col(f"_blk{c}").alias("_blk"), F.col(f"_need{c}").alias("_need"))
        for c in (0, 1)]))).where(F.col("_blk").isNotNull())
    edge_rows = e.join(edges if by else F.broadcast(edges), [*by, "group", "target_label", "_blk"], "inner")
    w_in = Window.partitionBy(*by, "group", "target_label", "_blk").orderBy(id_col)
    partial = edge_rows.withColumn("_pos", F.row_number().over(w_in)).where(F.col("_pos") <= F.col("_need"))
    part_stats = partial.groupBy(*by, "group").agg(*_sufficient_aggs())

    ps = part_stats.select(*by, "group", *[F.col(c).alias(f"_p_{c}") for c in _STAT_COLS])
    tot = res.join(ps, [*by, "group"], "left").select(
        *by, "group", "group_size",
        *[(F.col(c) + F.coalesce(F.col(f"_p_{c}"), F.lit(0))).alias(c) for c in _STAT_COLS])
    out_cols = by + ["group", "group_size", "n_rows", "loss", "loss_cdf", "loss_stddev", "loss_nll",
                     "tn", "fp", "fn", "tp", "Recall", "FPR", "Precision", "F1", "Accuracy"]
    return _finish_metrics(tot, coefficient).select(*out_cols)


def metrics_long(wide: DataFrame, metrics: list[str], by: list[str] | tuple = ()) -> DataFrame:
    """``(by..., group, metric, value)`` via unpivot of the wide table."""
    return wide.select(*by, "group", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        [*by, "group"], metrics, "metric", "value"
    )

