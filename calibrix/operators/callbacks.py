"""Functions of the user's in an evaluation: metrics of their own, and a transform of the forecasts before.

A metric is an object that starts, updates, merges and finishes a state. Tasks update a state per group from the rows
they have, batch by batch; the states (small, pickled) are merged per group in two levels, so neither a group's rows nor all of its
tasks' states come together in one place. A group of any size costs its tasks a state.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from typing import Any, Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.config import GROUPS
from calibrix.operators.groups import with_scopes
from calibrix.operators.losses import forecast_terms

# Groups whose states a task holds before it passes them on.
HELD_GROUPS = 10_000


class Metric(Protocol):
    """What a metric must have: the columns it reads, and the four steps. ``finish`` gives named values."""

    columns: list[str]

    def start(self) -> Any: ...

    def update(self, state: Any, rows: pd.DataFrame) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> dict[str, float]: ...


def aggregate_metrics(df: DataFrame, by: list[str], metrics: list[Metric]) -> DataFrame:
    """``by`` columns (nulls are a group), ``metric, value``: each metric of each group's rows."""
    columns = [*by, *dict.fromkeys(c for m in metrics for c in m.columns if c not in by)]
    rows = df.select(*columns)
    keys = [rows.schema[c] for c in by]
    state = T.StructType([*keys, T.StructField("task", T.IntegerType()), T.StructField("state", T.BinaryType())])
    partitions = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def merged(states: list[bytes]) -> list:
        first, *rest = (pickle.loads(x) for x in states)
        for other in rest:
            first = [m.merge(a, b) for m, a, b in zip(metrics, first, other, strict=True)]
        return first

    def partial(frames):
        held: dict[tuple, list] = {}
        task = TaskContext.get().partitionId()

        def out():
            frame = pd.DataFrame([(*k, task, pickle.dumps(s)) for k, s in held.items()], columns=state.names)
            held.clear()
            return frame

        for pdf in frames:
            for key, part in pdf.groupby(by, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                had = held.get(key) or [m.start() for m in metrics]
                held[key] = [m.update(s, part) for m, s in zip(metrics, had, strict=True)]
            if len(held) >= HELD_GROUPS:
                yield out()
        if held:
            yield out()

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(state=[pickle.dumps(merged(list(pdf["state"])))])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        values = {}
        for m, s in zip(metrics, merged(list(pdf["state"])), strict=True):
            values |= m.finish(s)
        return pd.DataFrame([(*pdf.iloc[0][by], k, float(v)) for k, v in values.items()], columns=[*by, "metric", "value"])

    states = rows.mapInPandas(partial, state).withColumn("task", F.pmod(F.col("task"), F.lit(math.isqrt(partitions) + 1)).cast("int"))
    states = states.groupBy(*by, "task").applyInPandas(some, state)
    return states.groupBy(*by).applyInPandas(final, T.StructType([*keys, T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType())]))


def evaluate(forecasts: DataFrame, metrics: list[Metric], preprocess: Callable[[DataFrame], DataFrame] | None = None,
             groups: list[str] = GROUPS) -> DataFrame:
    """``group, metric, value`` of the user's metrics over all labelled forecasts (``ALL``) and each group's members; ``preprocess`` changes the
    forecasts first. Metrics read the columns of ``forecast_terms`` (labels, predictions, losses) and the forecasts' own."""
    terms = forecast_terms(preprocess(forecasts) if preprocess else forecasts)
    columns = list(dict.fromkeys(c for m in metrics for c in m.columns))
    return aggregate_metrics(with_scopes(terms, columns, groups), ["group"], metrics)


class BalancedAccuracy:
    """Mean of the shares of each class that are predicted right; a class without rows counts as 0."""

    columns = ["target_label", "pred_label"]

    def start(self):
        return {(t, p): 0 for t in (0, 1) for p in (0, 1)}

    def update(self, state, rows):
        for k, n in rows.groupby(self.columns).size().items():
            state[k] += int(n)
        return state

    def merge(self, a, b):
        return {k: a[k] + b[k] for k in a}

    def finish(self, state):
        right = [state[t, t] / max(1, state[t, 0] + state[t, 1]) for t in (0, 1)]
        return {"balanced_accuracy": sum(right) / 2}


class Spread:
    """Mean and population standard deviation of a column, by merged means and squared gaps (no cancellation)."""

    def __init__(self, column: str):
        self.columns = [column]

    def start(self):
        return (0, 0.0, 0.0)

    def update(self, state, rows):
        x = rows[self.columns[0]].to_numpy(float)
        return self.merge(state, (len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum())))

    def merge(self, a, b):
        n = a[0] + b[0]
        if not n:
            return a
        gap = b[1] - a[1]
        return (n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n)

    def finish(self, state):
        return {f"{self.columns[0]}_mean": state[1], f"{self.columns[0]}_spread": math.sqrt(state[2] / max(1, state[0]))}
