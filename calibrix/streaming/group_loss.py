"""Per (event-time window, group) losses over a stream of forecast rows.

The stream keeps only sufficient sums per (window, group) in its state store (count, sum of the
cdf gap, of the nll, of the stddev), so state is bounded by windows x groups and the losses for any
coefficient are finished from the sums. Group membership is the long form (one row per member
group plus ``ALL``), unbalanced: the balanced subset depends on a global row order, which a stream
does not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from calibrix.config import DEFAULT_COEFFICIENT, GROUPS, OVERALL
from calibrix.operators.groups import member_condition
from calibrix.operators.losses import forecast_terms

SUM_COLS = ["n_rows", "s_cdf", "s_nll", "s_std"]


def window_sums(fc_stream: DataFrame, window: str = "1 day", watermark: str | None = "1 day",
                groups: list[str] = GROUPS, event_id: str | None = None) -> DataFrame:
    """Streaming aggregate ``(window_start, group) -> sums``; ``fc_stream`` has a ``ts`` column.

    ``event_id`` names a column by which redelivered events are told: of rows with one id only the first is counted. It is
    a stateful operator of its own before the sums; an id leaves its state when the watermark has passed its event, and
    a copy that comes later than that is late for the sums as well.

    Windows are aligned to UTC midnight. Event times stored without a zone are cast to timestamps
    in the session time zone, so day windows are calendar days when that zone is UTC (as
    ``get_session`` sets it)."""
    src = fc_stream.withWatermark("ts", watermark) if watermark else fc_stream
    if event_id:
        src = src.dropDuplicatesWithinWatermark([event_id]) if watermark else src.dropDuplicates([event_id])
    t = forecast_terms(src)
    items = [F.lit(OVERALL)] + [F.when(member_condition(g), F.lit(g)) for g in groups]
    longf = t.select("ts", "cdf_gap", "nll", "stddev",
                     F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("group"))
    return longf.groupBy(F.window("ts", window).alias("w"), "group").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("cdf_gap").alias("s_cdf"),
        F.sum("nll").alias("s_nll"),
        F.sum("stddev").alias("s_std"),
    ).select(F.col("w.start").alias("window_start"), "group", *SUM_COLS)


def finish_losses(sums: DataFrame, coefficient: float = DEFAULT_COEFFICIENT) -> DataFrame:
    """Losses from the sums (batch or stream output)."""
    n = F.col("n_rows")
    cdf = F.col("s_cdf") / n
    nll = F.col("s_nll") / n
    return sums.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"),
        "group",
        "n_rows",
        (F.lit(1.0 - coefficient) * cdf + F.lit(coefficient) * nll).alias("loss"),
        cdf.alias("loss_cdf"),
        (F.col("s_std") / n).alias("loss_stddev"),
        nll.alias("loss_nll"),
    )


def stream_group_loss(fc_stream: DataFrame, out_path: str, checkpoint: str, mode: str = "update",
                      window: str = "1 day", watermark: str = "1 day", trigger_available_now: bool = True, event_id: str | None = None):
    """Start T1 and return the ``StreamingQuery``.

    Both modes keep the windows of the last ``watermark`` of event time only in the state store; rows later than that are
    dropped (``WatermarkDrops`` counts them). ``mode="update"``: each micro-batch writes the windows it changed to a
    ``batch_id`` partition of its own (a replayed batch replaces itself) and ``latest_sums`` reads each window's last
    update, so windows still open are there too. ``mode="append"``: a parquet file sink that emits a window once, when the
    watermark passes it; windows still open when an ``availableNow`` run ends are not emitted.
    """
    sums = window_sums(fc_stream, window, watermark, event_id=event_id)
    if mode == "update":
        def write_batch(batch: DataFrame, batch_id: int) -> None:
            (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_path))

        w = sums.writeStream.outputMode("update").foreachBatch(write_batch)
    elif mode == "append":
        w = sums.writeStream.outputMode("append").format("parquet").option("path", out_path)
    else:
        raise ValueError("mode must be 'update' or 'append'")
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def latest_sums(spark: SparkSession, out_path: str) -> DataFrame:
    """Each window's and group's sums as of its last update."""
    rows = spark.read.parquet(out_path)
    last = rows.groupBy("window_start", "group").agg(F.max_by(F.struct(*SUM_COLS), F.col("batch_id")).alias("s"))
    return last.select("window_start", "group", "s.*")


class WatermarkDrops(StreamingQueryListener):
    """Counts the inputs that stateful aggregates discarded as later than the watermark, from every progress report of
    every query while it is registered (``spark.streams.addListener``). Spark counts them after partial aggregation:
    dropped partial groups, a lower bound on dropped rows."""

    def __init__(self):
        self.total = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.total += sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass
