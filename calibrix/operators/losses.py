"""Per-row probabilistic terms and the loss aggregates built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calibrix.config import DEFAULT_COEFFICIENT, LABEL_THRESHOLD
from calibrix.functions.math import clamp, gaussian_nll, sample_normal, with_normal_cdf
from calibrix.operators.ranking import global_rank, prefix_sum


def forecast_terms(fc: DataFrame, use_sample: bool = False, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Add ``cdf`` (PIT), ``cdf_gap = |cdf - r|``, ``nll``, ``pred_value``, ``pred_label``, ``target_label``.

    Rows without a label have none of these: they are left out here, once, for every loss and metric."""
    pred = sample_normal("mean", "stddev", id_col, seed) if use_sample else F.col("mean")
    return with_normal_cdf(fc.where(F.col("label").isNotNull()), "cdf").select(
        "*",
        gaussian_nll("label", "mean", "stddev").alias("nll"),
        clamp(pred, 0.0, 1.0).alias("pred_value"),
    ).select(
        "*",
        F.abs(F.col("cdf") - F.col("input_r")).alias("cdf_gap"),
        (F.col("pred_value") > LABEL_THRESHOLD).cast("int").alias("pred_label"),
        (F.col("label") > LABEL_THRESHOLD).cast("int").alias("target_label"),
    )


def loss_aggs(coefficient: float = DEFAULT_COEFFICIENT) -> list:
    """Aggregate expressions for the four losses over terms from ``forecast_terms``."""
    cdf = F.avg("cdf_gap")
    nll = F.avg("nll")
    return [
        ((F.lit(1.0 - coefficient)) * cdf + F.lit(coefficient) * nll).alias("loss"),
        cdf.alias("loss_cdf"),
        F.avg("stddev").alias("loss_stddev"),
        nll.alias("loss_nll"),
    ]


def overall_losses(fc: DataFrame, coefficient: float = DEFAULT_COEFFICIENT, id_col: str = "row_id") -> DataFrame:
    """One row: n_rows, loss, loss_cdf, loss_stddev, loss_nll over the whole table."""
    t = forecast_terms(fc, id_col=id_col)
    return t.agg(F.count(F.lit(1)).alias("n_rows"), *loss_aggs(coefficient))


def sufficient_stats(fc: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Sums from which every loss (for any coefficient) is finished: partial aggregation friendly."""
    t = forecast_terms(fc)
    return t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("cdf_gap").alias("s_cdf"),
        F.sum("nll").alias("s_nll"),
        F.sum("stddev").alias("s_std"),
    )


def expand_grid(df: DataFrame, coefficients: list[float]) -> DataFrame:
    """One copy of each row per coefficient (a literal array: no join, size fixed by the grid)."""
    return df.select("*", F.explode(F.array(*[F.lit(float(c)) for c in coefficients])).alias("coefficient"))


def alpha_sweep(fc: DataFrame, coefficients: list[float]) -> DataFrame:
    """eval_loss for every coefficient: losses are linear in alpha, so the data is aggregated
    once and the grid is expanded on the one-row result."""
    st = sufficient_stats(fc).select(
        (F.col("s_cdf") / F.col("n")).alias("loss_cdf"), (F.col("s_nll") / F.col("n")).alias("loss_nll")
    )
    return expand_grid(st, coefficients).select(
        "*",
        ((F.lit(1.0) - F.col("coefficient")) * F.col("loss_cdf") + F.col("coefficient") * F.col("loss_nll")).alias(
            "eval_loss"
        ),
    )


def best_alpha(sweep: DataFrame) -> DataFrame:
    """Coefficient minimising eval_loss (ties: smallest coefficient)."""
    return sweep.agg(
        F.min_by(F.col("coefficient"), F.struct("eval_loss", "coefficient")).alias("best_coefficient"),
        F.min("eval_loss").alias("best_eval_loss"),
        F.count(F.lit(1)).alias("n_runs"),
    )


def pairwise_gap(xs: DataFrame, ys: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """mean over all pairs (i, j) of |x_i - y_j| per ``by`` key, in O(n log n) without pairs.

    Inputs have columns ``by + [v]``. The pooled values are grouped by distinct value and a
    prefix sum gives the counts and sums strictly below each value:
        sum |x - y| = sum_v cx (v CY - SY) + cy (v CX - SX)
    """
    by = list(by)
    pooled = xs.select(*by, "v", F.lit(1).alias("_ix")).unionByName(ys.select(*by, "v", F.lit(0).alias("_ix")))
    return _pairwise_from_pooled(pooled, by)


def pairwise_gap_cols(df: DataFrame, x: str, y: str, by: list[str] | tuple = (), bounded_groups: bool = False) -> DataFrame:
    """``pairwise_gap`` for x and y taken from two columns of one frame (pooled in one pass).

    ``bounded_groups``: every ``by`` group holds a bounded number of rows (e.g. batches of B), so
    the running sums are a plain window per group instead of the prefix sum over sampled ranges."""
    by = list(by)
    pooled = df.select(*by, F.inline(F.array(F.struct(F.col(x).alias("v"), F.lit(1).alias("_ix")),
                                             F.struct(F.col(y).alias("v"), F.lit(0).alias("_ix")))))
    return _pairwise_from_pooled(pooled, by, bounded_groups)


def _pairwise_from_pooled(pooled: DataFrame, by: list[str], bounded_groups: bool = False) -> DataFrame:
    per = pooled.groupBy(*by, "v").agg(
        F.count(F.when(F.col("_ix") == 1, 1)).alias("cx"),
        F.sum(F.when(F.col("_ix") == 1, F.col("v")).otherwise(0.0)).alias("sx"),
        F.count(F.when(F.col("_ix") == 0, 1)).alias("cy"),
        F.sum(F.when(F.col("_ix") == 0, F.col("v")).otherwise(0.0)).alias("sy"),
    )
    if bounded_groups and by:
        w = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        ps = per.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_below") for c in ("cx", "sx", "cy", "sy")])
    else:
        ps = prefix_sum(per, "v", ["cx", "sx", "cy", "sy"], partition_by=by, strict=True)
    contrib = F.col("cx") * (F.col("v") * F.col("cy_below") - F.col("sy_below")) + F.col("cy") * (
        F.col("v") * F.col("cx_below") - F.col("sx_below")
    )
    return ps.groupBy(*by).agg(
        F.sum("cx").alias("n_x"), F.sum("cy").alias("n_y"), F.sum(contrib).alias("_tot")
    ).select(*by, "n_x", "n_y", (F.col("_tot") / (F.col("n_x") * F.col("n_y"))).alias("pairwise_gap"))


def batch_ids(fc: DataFrame, batch_size: int, id_col: str = "row_id", order_key: str | None = None) -> DataFrame:
    """``batch_id = floor((rank - 1) / B)`` in ``order_key`` (default: id) order, exact for any ids."""
    r = global_rank(fc, order_key or id_col, id_col, out="_brank")
    return r.withColumn("batch_id", F.floor((F.col("_brank") - 1) / F.lit(batch_size)).cast("bigint")).drop("_brank")


def batch_losses(fc: DataFrame, batch_size: int, coefficient: float = DEFAULT_COEFFICIENT) -> DataFrame:
    """Per batch of labelled rows: rows, mean losses, and the all-pairs cdf loss inside the batch (compat form)."""
    t = batch_ids(forecast_terms(fc).select("row_id", "cdf", "input_r", "cdf_gap", "nll", "stddev"), batch_size)
    per = t.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), *loss_aggs(coefficient))
    pairs = pairwise_gap_cols(t, "cdf", "input_r", by=["batch_id"], bounded_groups=True).select(
        "batch_id", F.col("pairwise_gap").alias("loss_cdf_pairs"))
    return per.join(pairs, "batch_id")


def batched_eval_loss(fc: DataFrame, batch_size: int, coefficient: float = DEFAULT_COEFFICIENT) -> DataFrame:
    """Two-level averages: mean of batch means (every batch weighs the same) and the row-weighted
    mean (a short last batch trimmed to its rows), plus the in-batch all-pairs cdf form."""
    b = batch_losses(fc, batch_size, coefficient)
    return b.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.avg("loss").alias("eval_loss"),
        F.avg("loss_cdf").alias("eval_cdf_loss"),
        F.avg("loss_nll").alias("eval_nll_loss"),
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("eval_loss_rows"),
        (F.sum(F.col("loss_cdf_pairs") * F.col("n")) / F.sum("n")).alias("eval_cdf_loss_pairs"),
    )
