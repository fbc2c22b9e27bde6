"""Inputs of the pipeline, derived from the driver's tables by hash formulas.

* ``comments``: labelled text with nine nullable identity-group scores (documents LEFT JOIN labels).
* ``predictions``: forecast rows ``(row_id, label, input_r, mean, stddev, groups...)`` from events.
* ``eval_log``: per-run evaluation losses ``(run_id, step, eval_loss)`` from events.

Formulas are shared with the SQL oracle (``calibrix.plans.oracle``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrix.config import GROUPS
from calibrix.functions.random import uniform
from calibrix.sources.tables import read_table

# Share of rows that are members (score 0.75) of each group, in GROUPS order.
PREDICTION_GROUP_RATES = [0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02, 0.015, 0.008]
# Share of forecast rows whose groups are unknown (sentinel -1).
PREDICTION_UNKNOWN_SHARE = 0.2
PART_NULL_SHARE = 0.05
# Share of forecast rows without a label.
UNLABELLED_SHARE = 0.2
EVAL_LOG_DAY0 = "2024-01-01"


def column_u(table: str, k: int, id_col) -> F.Column:
    """The ``k``-th uniform of a row: four from each digest, so a row of many random columns takes few digests."""
    return uniform(f"{table}{k // 4}", id_col, k % 4)


def comments(spark: SparkSession, sf_dir: str, part_null: bool = False) -> DataFrame:
    """``id, target, comment_text`` + nine groups.

    The target of a labelled document follows its labels: toxic ones lie in [0.5, 1), others of low quality in
    [0.25, 0.5), the rest in [0, 0.5) with many zeros; an unlabelled one's is a hash, and its groups are null. An id's
    several labels count as the highest ``toxic`` and the lowest ``quality``. The join on ``doc_id`` is a left join
    whose strategy Spark picks.
    """
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"]).groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("quality").alias("quality"), F.lit(True).alias("_labelled"))
    df = docs.join(labels, "doc_id", "left")
    idc = F.col("doc_id")
    nt, ut = column_u("comment", 0, idc), column_u("comment", 1, idc)
    target = (F.when(F.col("toxic") == 1, F.lit(0.5) + F.lit(0.5) * ut).when(F.col("quality") == 0, F.lit(0.25) + F.lit(0.25) * ut)
              .when(F.col("_labelled"), F.when(nt < 0.3, F.lit(0.0)).otherwise(F.lit(0.5) * ut))
              .when(nt < 0.2, F.lit(0.0)).when(nt > 0.98, F.lit(1.0)).otherwise(ut))
    cols = [idc.alias("id"), target.alias("target"), F.col("text").alias("comment_text")]
    for k, g in enumerate(GROUPS, 3):
        val = F.greatest(F.lit(0.0), F.floor(column_u("comment", k, idc) * 9) / F.lit(4.0) - F.lit(1.0))
        val = F.when(F.col("_labelled").isNull(), F.lit(None).cast("double")).otherwise(val.cast("double"))
        if part_null and g == GROUPS[0]:
            val = F.when(column_u("comment", 2, idc) < PART_NULL_SHARE, F.lit(None).cast("double")).otherwise(val)
        cols.append(val.alias(g))
    return df.select(*cols)


def hashed_id(col: str) -> F.Column:
    """60 bits of the id's md5: a sparse id that isn't in the order of the rows."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("id:"), F.col(col).cast("string"))), 1, 15), 16, 10).cast("bigint")


def forecasts_from_events(events: DataFrame, keep_ts: bool = False, hashed_ids: bool = False) -> DataFrame:
    """Forecast rows from an events frame (batch or stream); ``row_id = event_id``, or a hash of it.

    The label is the event's value over 100, 1 at most: skewed towards 0, with many ties and a heap at 1; a share of
    the rows has none. The forecast's mean follows the value with noise.
    """
    rid = F.col("event_id")
    y = F.least(F.col("value") / F.lit(100.0), F.lit(1.0))
    cols = [
        (hashed_id("event_id") if hashed_ids else rid).alias("row_id"),
        F.when(column_u("forecast", 0, rid) >= UNLABELLED_SHARE, y).alias("label"),
        column_u("forecast", 1, rid).alias("input_r"),
        (F.lit(0.6) * y + F.lit(0.4) * column_u("forecast", 2, rid)).alias("mean"),
        (F.lit(0.05) + F.lit(0.45) * column_u("forecast", 3, rid)).alias("stddev"),
    ]
    unknown = column_u("forecast", 4, rid) < PREDICTION_UNKNOWN_SHARE
    for k, (g, p) in enumerate(zip(GROUPS, PREDICTION_GROUP_RATES), 5):
        cols.append(
            F.when(unknown, F.lit(-1.0)).when(column_u("forecast", k, rid) < p, F.lit(0.75)).otherwise(F.lit(0.0)).alias(g)
        )
    if keep_ts:
        cols.append(F.col("ts").cast("timestamp").alias("ts"))
    return events.select(*cols)


def predictions(spark: SparkSession, sf_dir: str, keep_ts: bool = False, hashed_ids: bool = False) -> DataFrame:
    columns = ["event_id", "value", *(["ts"] if keep_ts else [])]
    return forecasts_from_events(read_table(spark, sf_dir, "events", columns), keep_ts, hashed_ids)


def run_predictions(spark: SparkSession, sf_dir: str, coefficients: list[float]) -> DataFrame:
    """The forecasts of every run of a sweep, with the run's ``coefficient``: the larger it is, the closer its means
    are to 0.5 and the wider its spread."""
    c = F.col("coefficient")
    p = predictions(spark, sf_dir).withColumn("coefficient", F.explode(F.array(*[F.lit(float(x)) for x in coefficients])))
    return p.withColumn("mean", (F.lit(1.0) - F.lit(0.5) * c) * F.col("mean") + F.lit(0.25) * c).withColumn(
        "stddev", F.col("stddev") * (F.lit(0.5) + c))


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run_id, step, eval_loss)``: run = event type, step = day index, loss = mean value."""
    ev = read_table(spark, sf_dir, "events", ["ts", "event_type", "value"])
    step = F.datediff(F.to_date(F.col("ts")), F.to_date(F.lit(EVAL_LOG_DAY0)))
    return (
        ev.groupBy(F.col("event_type").alias("run_id"), step.cast("bigint").alias("step"))
        .agg(F.round(F.avg("value"), 6).alias("eval_loss"))
    )
