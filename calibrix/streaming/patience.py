"""Early stopping over a stream of evaluation results, with per-run state (``transformWithStateInPandas`` on RocksDB).

A run's evaluations are numbered (``eval_no``, 1, 2, ...) and may arrive in any order, across batches too, and more than once. State
per run: the patience summary (a few numbers), a map of the evaluations that came before their turn, and a list of one timer. An
evaluation is taken when all before it have been; one that is already taken or waiting is a redelivery and ignored.

A timer (event time) bounds the state. It is set ``wait`` after a run's latest event: if the watermark passes it with evaluations
still waiting for a missing one, they are taken without it (``n_missing`` counts what was passed over), else the run is over and its
state is removed. So a run's state is a summary and at most the evaluations of ``wait``, and nothing stays for ever.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from calibrix.config import PATIENCE

STATUS_SCHEMA_COLS = ["run_id", "n_evals", "stop_step", "best_loss", "best_step"]
STATUS_SCHEMA = "run_id string, n_evals long, stop_step long, best_loss double, best_step long, n_missing long, at timestamp"
SUMMARY_SCHEMA = ("next_no long, n_evals long, n_missing long, best_loss double, best_step long, bad long, stop_step long, stop_loss double, "
                  "stop_best long")
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAIT = "7 days"


@dataclass
class Summary:
    """What is known of a run after the evaluations taken so far."""

    next_no: int = 1
    n_evals: int = 0
    n_missing: int = 0
    best_loss: float | None = None
    best_step: int | None = None
    bad: int = 0
    stop_step: int | None = None
    stop_loss: float | None = None
    stop_best: int | None = None

    def take(self, steps: np.ndarray, losses: np.ndarray, patience: int) -> None:
        """The next evaluations, in order; one without a loss improves nothing."""
        if not len(steps):
            return
        start = np.inf if self.best_loss is None else self.best_loss
        before = np.fmin.accumulate(np.concatenate([[start], losses]))  # best loss before each evaluation
        at = np.arange(len(losses))
        last = np.maximum.accumulate(np.where(losses < before[:-1], at, -1))  # the last improvement up to each
        waited = np.where(last >= 0, at - last, at + 1 + self.bad)
        if self.stop_step is None and (waited >= patience).any():
            i = int(np.argmax(waited >= patience))
            self.stop_step, self.stop_loss = int(steps[i]), None if np.isinf(before[i + 1]) else float(before[i + 1])
            self.stop_best = int(steps[last[i]]) if last[i] >= 0 else self.best_step
        self.n_evals += len(losses)
        if last[-1] >= 0:
            self.best_loss, self.best_step = float(losses[last[-1]]), int(steps[last[-1]])
        self.bad = int(waited[-1])

    def status(self, run: str, at_ms: int) -> pd.DataFrame:
        """The run as of its stop, if it has stopped."""
        loss, step = (self.stop_loss, self.stop_best) if self.stop_step is not None else (self.best_loss, self.best_step)
        row = {"run_id": run, "n_evals": self.n_evals, "stop_step": self.stop_step, "best_loss": loss, "best_step": step,
               "n_missing": self.n_missing, "at": pd.Timestamp(at_ms, unit="ms")}
        return pd.DataFrame([row]).astype({"best_loss": "float64", "stop_step": "Int64", "best_step": "Int64"})


class EarlyStop(StatefulProcessor):
    """Input rows: ``eval_no, step, eval_loss, ts`` of a run."""

    def __init__(self, patience: int, wait_ms: int):
        self.patience, self.wait_ms = patience, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.summary = handle.getValueState("summary", SUMMARY_SCHEMA)
        self.waiting = handle.getMapState("waiting", "eval_no long", "step long, eval_loss double")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        summary = Summary(*self.summary.get()) if self.summary.exists() else Summary()
        latest = 0
        for pdf in rows:
            latest = max(latest, int(pdf["ts"].max().value // 1_000_000))
            for no, step, loss in zip(pdf["eval_no"], pdf["step"], pdf["eval_loss"], strict=True):
                if no >= summary.next_no and not self.waiting.containsKey((int(no),)):
                    self.waiting.updateValue((int(no),), (int(step), None if pd.isna(loss) else float(loss)))
        self._take(summary, False)
        self._set_timer(latest + self.wait_ms)
        yield summary.status(key[0], latest)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.summary.exists():
            return
        summary, at = Summary(*self.summary.get()), expiredTimerInfo.getExpiryTimeInMs()
        if next(iter(self.waiting.keys()), None) is None:
            for state in (self.summary, self.waiting, self.due):
                state.clear()
            return
        self._take(summary, True)
        self.due.clear()
        self._set_timer(at + self.wait_ms)
        yield summary.status(key[0], at)

    def _take(self, summary: Summary, all_of_them: bool) -> None:
        """Evaluations whose turn it is; ``all_of_them``: with what is missing passed over."""
        steps, losses = [], []
        if all_of_them:
            numbers = sorted(int(k[0]) for k in self.waiting.keys())
        else:
            numbers, no = [], summary.next_no
            while self.waiting.containsKey((no,)):
                numbers.append(no)
                no += 1
        for no in numbers:
            step, loss = self.waiting.getValue((no,))
            steps.append(step)
            losses.append(np.nan if loss is None else loss)
            self.waiting.removeKey((no,))
            summary.n_missing += no - summary.next_no
            summary.next_no = no + 1
        summary.take(np.array(steps, np.int64), np.array(losses, float), self.patience)
        self.summary.update(astuple(summary))

    def _set_timer(self, ms: int) -> None:
        """One timer a run, at the latest time asked for."""
        had = self.due.get()[0] if self.due.exists() else None
        if had is not None and had >= ms:
            return
        if had is not None:
            self.handle.deleteTimer(had)
        self.handle.registerTimer(ms)
        self.due.update((ms,))


def early_stop_status(log_stream: DataFrame, patience: int = PATIENCE, wait: str = WAIT) -> DataFrame:
    """Streaming status rows, one per run in each micro-batch where the run received evaluations or its timer was due. ``log_stream``:
    ``run_id, eval_no, step, eval_loss, ts``; rows more than ``wait`` behind the latest event are late and dropped."""
    ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    rows = log_stream.select("run_id", "eval_no", "step", "eval_loss", "ts").withWatermark("ts", wait)
    return rows.groupBy("run_id").transformWithStateInPandas(EarlyStop(patience, ms), STATUS_SCHEMA, "Update", "EventTime")


def stream_early_stop(log_stream: DataFrame, out_path: str, checkpoint: str, patience: int = PATIENCE,
                      trigger_available_now: bool = True, wait: str = WAIT):
    """Start T2: each micro-batch's status rows go to their own ``batch_id`` partition (dynamic
    overwrite, so a replayed batch replaces itself). ``latest_status`` reads the answer."""
    spark = log_stream.sparkSession
    status = early_stop_status(log_stream, patience, wait)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(out_path))

    w = status.writeStream.outputMode("update").foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="10 seconds")
    had = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)  # a query takes the setting of its start
    try:
        return w.start()
    finally:
        spark.conf.set(STORE, had) if had else spark.conf.unset(STORE)


def numbered(log: DataFrame) -> DataFrame:
    """A batch log with the ``eval_no`` that its writer would give: a run's evaluations counted by step."""
    from pyspark.sql import Window

    return log.withColumn("eval_no", F.row_number().over(Window.partitionBy("run_id").orderBy("step")).cast("long"))


def latest_status(spark, out_path: str) -> DataFrame:
    """Last status per run over all batches written so far (a partial aggregate per run)."""
    st = spark.read.parquet(out_path)
    last = st.groupBy("run_id").agg(F.max_by(F.struct("n_evals", "stop_step", "best_loss", "best_step"), F.struct("batch_id", "n_evals")).alias("s"))
    return last.select("run_id", "s.*")
