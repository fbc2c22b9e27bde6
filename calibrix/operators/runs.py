"""Run-level analytics: early stopping, best checkpoint, LR schedule, parameter grid, group
extremes and the trade-off points plotted per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibrix.config import (
    DEFAULT_SEED,
    HIGHER_IS_BETTER,
    LOWER_IS_BETTER,
    MEAN_METRICS,
    OVERALL,
    PATIENCE,
    SWEEP_COEFFICIENTS,
    SWEEP_LEARNING_RATES,
    WARMUP_RATIO,
)
from calibrix.functions.strings import run_name


# ------------------------------------------------------------------ patience logic
def _known(loss: str) -> Column:
    """The loss, null where it is null or not a number: an evaluation without a loss improves nothing."""
    return F.when(~F.isnan(loss), F.col(loss))


def patience_trace(log: DataFrame, run: str = "run_id", step: str = "step", loss: str = "eval_loss") -> DataFrame:
    """Per evaluation: ``improved`` (there's a loss, strictly below every earlier one), ``bad`` = evaluations since the last
    improvement (since the start before the first), running ``best_loss`` and its ``best_step``.

    One window partition per run; a run's log holds one row per evaluation.
    """
    w_prev = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    w_cum = Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    t = log.withColumn("_loss", _known(loss))
    prev_best = F.min("_loss").over(w_prev)
    t = t.withColumn("improved", F.col("_loss").isNotNull() & (prev_best.isNull() | (F.col("_loss") < prev_best)))
    t = t.withColumn("_island", F.sum(F.col("improved").cast("int")).over(w_cum))
    w_isl = Window.partitionBy(run, "_island").orderBy(step)
    t = t.withColumn("bad", (F.row_number().over(w_isl) - F.when(F.col("_island") > 0, 1).otherwise(0)).cast("bigint"))
    t = t.withColumn("best_loss", F.min("_loss").over(w_cum))
    t = t.withColumn("best_step", F.min_by(F.col(step), F.when(F.col("_loss").isNotNull(), F.struct("_loss", step))).over(w_cum))
    return t.drop("_island", "_loss")


def early_stop(log: DataFrame, patience: int = PATIENCE, run: str = "run_id", step: str = "step",
               loss: str = "eval_loss") -> DataFrame:
    """Per run: the first step at which ``patience`` evaluations in a row failed to improve
    (null when training would run to the end), with the best loss and step at that point."""
    t = patience_trace(log, run, step, loss)
    hit = t.where(F.col("bad") >= patience)
    first = hit.groupBy(run).agg(F.min_by(F.struct(step, "best_loss", "best_step"), F.col(step)).alias("_f"))
    last = t.groupBy(run).agg(
        F.min_by(F.col(step), F.when(_known(loss).isNotNull(), F.struct(loss, step))).alias("_bs"), F.min(_known(loss)).alias("_bl"),
        F.count(F.lit(1)).alias("n_evals"),
    )
    j = last.join(first, run, "left")
    return j.select(
        run,
        "n_evals",
        F.col("_f").getField(step).alias("stop_step"),
        F.when(F.col("_f").isNotNull(), F.col("_f.best_loss")).otherwise(F.col("_bl")).alias("best_loss"),
        F.when(F.col("_f").isNotNull(), F.col("_f.best_step")).otherwise(F.col("_bs")).alias("best_step"),
    )


# ------------------------------------------------------------------ schedule
def total_steps(n_train, batch_size: int, epochs: int):
    """``int(n / B * epochs)`` (float division, truncated)."""
    return F.floor(F.col(n_train) / F.lit(float(batch_size)) * F.lit(float(epochs))).cast("bigint")


def lr_schedule(spark: SparkSession, n_train: DataFrame, base_lr: float, batch_size: int, epochs: int,
                warmup_ratio: float = WARMUP_RATIO) -> DataFrame:
    """Linear warm-up then linear decay for every optimiser step.

    ``n_train`` is a one-row frame with column ``n``; steps are generated by ``range`` (split
    over tasks), so nothing of size ``total`` passes through the driver.
    """
    tot = n_train.select(total_steps("n", batch_size, epochs).alias("total"))
    tot = tot.select("total", F.floor(F.lit(float(warmup_ratio)) * F.col("total")).cast("bigint").alias("warmup"))
    total = tot.first()  # two numbers
    t, wu = int(total["total"]), int(total["warmup"])
    s = spark.range(0, t).withColumnRenamed("id", "step")
    factor = F.when(F.col("step") < wu, F.col("step") / F.lit(float(max(1, wu)))).otherwise(
        F.greatest(F.lit(0.0), (F.lit(t) - F.col("step")) / F.lit(float(max(1, t - wu))))
    )
    return s.select("step", (F.lit(float(base_lr)) * factor).alias("lr"))


# ------------------------------------------------------------------ grid
def param_grid(spark: SparkSession, seed: int = DEFAULT_SEED) -> DataFrame:
    """The sweep grid (learning rate x coefficient), with printed forms and run names.

    Run names are built by the column function ``run_name`` from the printed forms.
    """
    rows = [(float(lr), float(c), str(lr), str(c)) for lr in SWEEP_LEARNING_RATES for c in SWEEP_COEFFICIENTS]
    grid = spark.createDataFrame(rows, "learning_rate double, coefficient double, lr_str string, coefficient_str string")
    return grid.withColumn("run_name", run_name(F.lit(str(seed)), F.col("coefficient_str"), F.col("lr_str")))


# ------------------------------------------------------------------ summaries
def group_extremes(long: DataFrame, by: list[str] | tuple = (), tpr_alias: bool = False) -> DataFrame:
    """Per metric over the group rows (not ALL): worst, best (by direction) and mean.

    Metrics absent from the table are skipped (e.g. ``TPR``; ``tpr_alias`` maps it to Recall).
    """
    g = long.where(F.col("group") != OVERALL)
    if tpr_alias:
        g = g.unionByName(g.where(F.col("metric") == "Recall").withColumn("metric", F.lit("TPR")))
    g = g.where(F.col("metric").isin(*MEAN_METRICS))
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    higher = F.col("metric").isin(*HIGHER_IS_BETTER)
    return g.groupBy(*by, "metric").agg(
        F.when(F.first(lower), F.max("value")).when(F.first(higher), F.min("value")).alias("worst_group"),
        F.when(F.first(lower), F.min("value")).when(F.first(higher), F.max("value")).alias("best_group"),
        F.avg("value").alias("mean"),
        F.count(F.lit(1)).alias("n_groups"),
    )


def group_spread(long: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    g = long.where(F.col("group") != OVERALL)
    return g.groupBy(*by, "metric").agg((F.max("value") - F.min("value")).alias("spread"))


# The (x, y) key pairs of the trade-off scatters, in plotting order.
TRADEOFF_PAIRS = [
    ("loss_cdf_worst_group", "loss_nll"),
    ("loss_cdf_worst_group", "loss_stddev"),
    ("Accuracy_worst_group", "Accuracy"),
    ("F1_worst_group", "F1"),
    ("TPR_worst_group", "TPR"),
    ("FPR_worst_group", "FPR"),
    ("Recall_worst_group", "Recall"),
    ("Precision_worst_group", "Precision"),
    ("Accuracy_best_group", "Accuracy_worst_group"),
    ("F1_best_group", "F1_worst_group"),
    ("TPR_best_group", "TPR_worst_group"),
    ("FPR_best_group", "FPR_worst_group"),
    ("Recall_worst_group", "Recall_worst_group"),
    ("Precision_worst_group", "Precision_worst_group"),
]


def tradeoff_pairs(compat: bool = False) -> list[tuple[str, str]]:
    """The 14 pairs; by default the last two compare best against worst group (compat: as plotted)."""
    if compat:
        return list(TRADEOFF_PAIRS)
    fixed = list(TRADEOFF_PAIRS)
    fixed[12] = ("Recall_best_group", "Recall_worst_group")
    fixed[13] = ("Precision_best_group", "Precision_worst_group")
    return fixed


def summary_keys(long: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., key, value)``: overall metrics under their bare names plus the
    ``{metric}_worst_group / _best_group / _mean`` summaries (one pass over the extremes)."""
    ext = group_extremes(long, by)
    overall = long.where(F.col("group") == OVERALL).select(*by, F.col("metric").alias("key"), "value")
    items = F.array(*[F.struct(F.concat("metric", F.lit(suffix)).alias("key"), F.col(col).alias("value"))
                      for col, suffix in (("worst_group", "_worst_group"), ("best_group", "_best_group"), ("mean", "_mean"))])
    summ = ext.select(*by, F.inline(items)).where(F.col("value").isNotNull())
    return overall.unionByName(summ)


def tradeoff_points(long: DataFrame, by: list[str], compat: bool = False) -> DataFrame:
    """Per run: one ``(key_x, key_y, x, y)`` row per scatter whose two keys both exist."""
    keys = summary_keys(long, by)
    pairs = tradeoff_pairs(compat)
    needed = sorted({k for p in pairs for k in p})
    wide = keys.where(F.col("key").isin(*needed)).groupBy(*by).pivot("key", needed).agg(F.first("value"))
    pts = F.inline(F.array(*[
        F.struct(F.lit(i).alias("pair"), F.lit(x).alias("key_x"), F.lit(y).alias("key_y"),
                 F.col(f"`{x}`").alias("x"), F.col(f"`{y}`").alias("y"))
        for i, (x, y) in enumerate(pairs)
    ]))
    return wide.select(*by, pts).where(F.col("x").isNotNull() & F.col("y").isNotNull())
