"""Gradient fitting as Spark jobs (M3 head, M4 calibration layer, M7 sweep): synchronous mini-batch steps.

The training rows get their place in a seeded order (an exact rank), and with it their batch: step ``k`` takes the rows with
places ``k * batch_size`` on, the same rows for any number of tasks. A large batch is dealt over tasks, and each step is one job: tasks
compute the gradient of their share at the same parameters, the shares are summed across tasks (of a few by the driver; of more in two
levels, about the square root of their number of groups first, so that nobody receives a vector from every task), and the driver takes
the optimiser's step with the sum. A batch of ``CHAIN_ROWS`` rows at most is one task's: its gradient takes a small share of the time
that a job does, so a job takes up to ``CHAIN_STEPS`` steps one after the other, and hands the parameters and the optimiser's state
on to the next. Either way the parameters are those of a single process that takes the same batches, up to the rounding of sums; the
number of tasks, the cluster's settings and the partitioning of the input don't matter.

The rows are written once by blocks of steps, packed to arrays: a record for each step and each of ``tasks`` lanes. An epoch goes
through the blocks, one at a time; a job runs on the partitions that have its steps, with no plan of its own (with more than
``DIRECT_TASKS`` lanes, the sum's two shuffles). What a step costs doesn't grow with the table, the memory needed is a block's, and no
task gets more than a part of a block. Messages are of the model's size.

A step of a dealt batch is a job rather than a barrier between tasks of one job, as Spark's barriers (``allGather``) take a second each
and hand every message to every task.

A sweep trains all its (learning rate, coefficient) points in the same steps: a batch is read once for the whole grid.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterable, Iterator
from copy import deepcopy
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.config import CALIB_LR, GLOBAL_BATCH_SIZE, NUM_EPOCHS, PATIENCE, WARMUP_RATIO, fresh_path
from calibrix.functions.random import uniform
from calibrix.operators import models as M
from calibrix.operators.ranking import global_rank

# Per grid point and task: rows, summed loss, and the parameters times the rows.
PARTIAL_SCHEMA = "key int, task int, n long, loss double, g array<double>"
# Rows and steps of a block at most (whole steps, one at least); steps whose records are a partition; tasks whose vectors the driver adds up itself.
BLOCK_ROWS, BLOCK_STEPS, READ_STEPS, DIRECT_TASKS = 1 << 20, 4096, 16, 8
# Rows of a batch that one task takes, and steps of such batches in a job at most.
CHAIN_ROWS, CHAIN_STEPS = 1000, 256
# The rows for each task of a larger batch, unless the number of tasks is given.
HEAD_TASK_ROWS, CALIB_TASK_ROWS = 16, 250


class Descent:
    """Plain gradient descent."""

    def step(self, theta: np.ndarray, grad: np.ndarray, lr: float) -> np.ndarray:
        return theta - lr * grad


class Adam:
    def __init__(self, theta: np.ndarray, betas=(0.9, 0.999), eps: float = 1e-8, weight_decay: float = 0.0):
        self.m = np.zeros_like(theta)
        self.v = np.zeros_like(theta)
        self.t = 0
        self.b1, self.b2 = betas
        self.eps = eps
        self.wd = weight_decay

    def step(self, theta: np.ndarray, grad: np.ndarray, lr: float) -> np.ndarray:
        self.t += 1
        if self.wd:
            theta = theta - lr * self.wd * theta
        self.m = self.b1 * self.m + (1 - self.b1) * grad
        self.v = self.b2 * self.v + (1 - self.b2) * grad * grad
        mh = self.m / (1 - self.b1 ** self.t)
        vh = self.v / (1 - self.b2 ** self.t)
        return theta - lr * mh / (np.sqrt(vh) + self.eps)


def linear_warmup_decay(base_lr: float, total: int, warmup_ratio: float = WARMUP_RATIO) -> Callable[[int], float]:
    """Linear warm-up to ``base_lr`` then linear decay to 0 at ``total`` steps."""
    warm = int(total * warmup_ratio)

    def lr(step: int) -> float:
        if step < warm:
            return base_lr * step / max(1, warm)
        return base_lr * max(0.0, (total - step) / max(1, total - warm))

    return lr


def summed_partials(partials: DataFrame, tasks: int) -> dict[int, tuple[int, float, np.ndarray]]:
    """``key -> (rows, loss sum, vector sum)``, added up in two levels; one row per key reaches the driver."""
    groups = max(1, math.isqrt(tasks))

    def add(df: DataFrame, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), Summarizer.sum(F.col("g")).alias("g"))

    some = partials.withColumn("g", array_to_vector("g")).withColumn("part", F.col("task") % groups)
    if groups > 1:
        some = add(some, "key", "part")
    return {r["key"]: (int(r["n"]), float(r["loss"]), r["g"].toArray()) for r in add(some, "key").collect()}


Arrays = dict[str, np.ndarray]
Local = Callable[[dict[int, np.ndarray], Arrays], dict[int, tuple[float, np.ndarray]]]


def local_sums(records: Iterable, thetas: dict[int, np.ndarray], local: Local) -> tuple[int, dict[int, tuple[float, np.ndarray]]]:
    """A task's number of rows and ``key -> (loss sum, gradient sum)`` at ``thetas`` over packed records."""
    n, sums = 0, {}
    for data in records:
        arrays = pickle.loads(data)
        n += len(next(iter(arrays.values())))
        for k, (loss, g) in local(thetas, arrays).items():
            had = sums.get(k, (0.0, 0.0))
            sums[k] = (had[0] + loss, had[1] + g)
    return n, sums


@dataclass
class Point:
    """Parameters and optimiser of one grid point, with the rows and the losses since the last evaluation."""

    theta: np.ndarray
    optimiser: Adam | Descent
    n: int = 0
    loss: float = 0.0

    def take(self, n: int, loss: float, g: np.ndarray, lr: float) -> None:
        self.theta = self.optimiser.step(self.theta, g / n, lr)
        self.n, self.loss = self.n + n, self.loss + loss


Rates = Callable[[int, int], float]


@dataclass
class Steps:
    """Consecutive steps' packed rows: a partition of a block; of a dealt batch one step's partitions, or a frame where there are many tasks."""

    steps: range
    rows: list[int]
    held: RDD | DataFrame
    parts: list[int]

    def take(self, points: dict[int, Point], local: Local, rates: Rates) -> dict[int, Point]:
        """The points after these steps; ``local`` gives a record's loss and gradient sums, ``rates`` a point's learning rate at a step."""
        if len(self.parts) == 1:
            return self._chain(points, local, rates)
        sums = self._sums({k: p.theta for k, p in points.items()}, local)
        for k, (n, loss, g) in sums.items():
            if n != self.rows[0]:
                raise RuntimeError(f"step {self.steps[0]} has {n} of its {self.rows[0]} rows")
            points[k].take(n, loss, g, rates(k, self.steps[0]))
        return points

    def _chain(self, points: dict[int, Point], local: Local, rates: Rates) -> dict[int, Point]:
        """One task takes the steps in turn; the points go to it and come back."""
        sc, steps, rows = self.held.context, self.steps, self.rows
        bc = sc.broadcast(points)  # model-sized

        def run(records):
            now, left = deepcopy(bc.value), dict(zip(steps, rows, strict=True))
            for step, some in groupby((r for r in records if r["_step"] in left), lambda r: r["_step"]):
                n, sums = local_sums((r["data"] for r in some), {k: p.theta for k, p in now.items()}, local)
                left[step] -= n
                for k, (loss, g) in sums.items():
                    now[k].take(n, loss, g, rates(k, step))
            if any(left.values()):
                raise RuntimeError(f"steps without all their rows: {[s for s, n in left.items() if n]}")
            yield now

        [now] = sc.runJob(self.held, run, self.parts)
        bc.destroy()
        return now

    def _sums(self, thetas: dict[int, np.ndarray], local: Local) -> dict[int, tuple[int, float, np.ndarray]]:
        """One step's ``key -> (rows, loss sum, gradient sum)`` over its tasks."""
        direct, step, out = isinstance(self.held, RDD), self.steps[0], {}
        sc = self.held.context if direct else self.held.sparkSession.sparkContext
        bc = sc.broadcast(thetas)  # model-sized

        def share(records):
            yield local_sums((r["data"] for r in records if r["_step"] == step), bc.value, local)

        def frames(pdfs):
            n, sums = local_sums((data for pdf in pdfs for data in pdf["data"]), bc.value, local)
            task = TaskContext.get().partitionId()
            yield pd.DataFrame([(k, task, n, loss, g.tolist()) for k, (loss, g) in sums.items()], columns=["key", "task", "n", "loss", "g"])

        if direct:
            for n, sums in sc.runJob(self.held, share, self.parts):
                for k, (loss, g) in sums.items():
                    had = out.get(k, (0, 0.0, 0.0))
                    out[k] = (had[0] + n, had[1] + loss, had[2] + g)
        else:
            out = summed_partials(self.held.where(F.col("_step") == step).mapInPandas(frames, PARTIAL_SCHEMA), len(self.parts))
        bc.destroy()
        return out


@dataclass
class Batches:
    """Training rows by step, packed and written by blocks of steps."""

    rows: DataFrame
    n: int
    batch_size: int
    steps_per_block: int
    tasks: int

    @property
    def steps(self) -> int:
        return math.ceil(self.n / self.batch_size)

    def first(self) -> Arrays | None:
        """A record's arrays, None without rows."""
        row = self.rows.select("data").first()
        return pickle.loads(row["data"]) if row else None

    def runs(self, cut: int | None = None, done: int = 0) -> Iterator[Steps]:
        """An epoch's steps in order, as far as a job takes them: to a partition's end, and to a multiple of ``cut`` steps after
        ``done`` earlier ones. A block of dealt batches is cached as long as its steps are taken."""
        size = CHAIN_STEPS if self.tasks == 1 else READ_STEPS
        for first in range(0, self.steps, self.steps_per_block):
            last = min(self.steps, first + self.steps_per_block)
            block = self.rows.where(F.col("_block") == first // self.steps_per_block).select("_step", "_lane", "data")
            if self.tasks > DIRECT_TASKS:
                held = block.repartition(self.tasks, "_lane").sortWithinPartitions("_step")
            else:
                place = F.floor((F.col("_step") - first) / size) * self.tasks + F.col("_lane")
                held = block.repartitionById(math.ceil((last - first) / size) * self.tasks, place.cast("int"))
                held = held.sortWithinPartitions("_step").select("_step", "data").rdd
            if self.tasks > 1:
                held.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                step = first
                while step < last:
                    at = (step - first) // size
                    end = min(last, first + (at + 1) * size, step + cut - (done + step) % cut if cut else last) if self.tasks == 1 else step + 1
                    rows = [min(self.batch_size, self.n - k * self.batch_size) for k in range(step, end)]
                    yield Steps(range(step, end), rows, held, list(range(at * self.tasks, (at + 1) * self.tasks)))
                    step = end
            finally:
                if self.tasks > 1:
                    held.unpersist()


def dealt_over(batch_size: int, task_rows: int) -> int:
    """Tasks of a batch: one if it is small."""
    return 1 if batch_size <= CHAIN_ROWS else math.ceil(batch_size / task_rows)


def packed(pdfs: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Records (block, step, lane, rows, the columns' arrays) of rows that are sorted by step within each block's lanes."""
    keys, rest = ["_block", "_step", "_lane"], None

    def record(key: tuple, pdf: pd.DataFrame) -> tuple:
        nested = lambda c: len(pdf) and isinstance(pdf[c].iloc[0], np.ndarray)
        return (*key, len(pdf), pickle.dumps({c: np.stack(pdf[c].to_numpy()) if nested(c) else pdf[c].to_numpy() for c in columns}))

    def frame(found: list[tuple[tuple, pd.DataFrame]]) -> pd.DataFrame:
        return pd.DataFrame([record(k, f) for k, f in found], columns=[*keys, "n", "data"])

    for pdf in pdfs:
        found = list((pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)).groupby(keys, sort=False))
        rest = found.pop()[1] if found else None  # may go on in the next frame
        yield frame(found)
    if rest is not None:
        yield frame(list(rest.groupby(keys, sort=False)))


def batches(df: DataFrame, id_col: str, columns: list[str], batch_size: int, salt: str, tasks: int, block_rows: int | None = None) -> Batches:
    """``columns`` of ``df`` in batches of ``batch_size`` rows of its seeded order (the last may be smaller); ids are unique."""
    spark, at = df.sparkSession, F.col("_place") - 1
    per_block = max(1, min(BLOCK_STEPS, (block_rows or BLOCK_ROWS) // batch_size))
    rows = global_rank(df.withColumn("_order", uniform(salt, id_col)), "_order", id_col, out="_place")
    rows = rows.withColumn("_step", F.floor(at / batch_size).cast("long")).withColumn("_lane", F.pmod(at, F.lit(tasks)).cast("int"))
    rows = rows.withColumn("_block", F.floor(F.col("_step") / per_block).cast("long"))
    rows = rows.repartition("_block", "_lane").sortWithinPartitions("_block", "_lane", "_place").select("_block", "_step", "_lane", *columns)
    schema, path = "_block long, _step long, _lane int, n long, data binary", fresh_path(spark, "training_blocks")
    rows.mapInPandas(lambda pdfs: packed(pdfs, columns), schema).write.partitionBy("_block").parquet(path)
    rows = spark.read.schema(schema).parquet(path)
    return Batches(rows, rows.agg(F.sum("n")).first()[0] or 0, batch_size, per_block, tasks)


def _head_arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(pdf["x"].to_numpy()), pdf["input_r"].to_numpy(float), pdf["label"].to_numpy(float)


def _head_local(grid: list[tuple[float, float]], like: dict, id_col: str, epoch: int, drop: float, seed: int) -> Local:
    def local(thetas, rows):
        x, r, y = rows["x"], rows["input_r"].astype(float), rows["label"].astype(float)
        mask = M.dropout_mask(rows[id_col].astype(np.int64), like["b2"].size, epoch, drop, seed) if drop else 1.0
        return {k: M.head_loss_grad(M.unflatten(t, like), x, r, y, grid[k][1], mask) for k, t in thetas.items()}

    return local


def _after(schedule: dict[int, Callable[[int], float]], done: int) -> Rates:
    return lambda k, step: schedule[k](done + step)


def _head_losses(rows: DataFrame, thetas: dict[int, np.ndarray], grid: list[tuple[float, float]], like: dict):
    bc = rows.sparkSession.sparkContext.broadcast(thetas)

    def run(frames):
        out = []
        for pdf in frames:
            if len(pdf):
                x, r, y = _head_arrays(pdf)
                for k, t in bc.value.items():
                    mean, std = M.head_forward(M.unflatten(t, like), x, r)
                    out.append((k, len(pdf), float(M.loss_terms(y, r, mean, std, grid[k][1])[0].sum())))
        yield pd.DataFrame(out, columns=["key", "n", "loss"])

    return rows.mapInPandas(run, "key int, n long, loss double"), bc


def eval_losses(rows: DataFrame, thetas: dict[int, np.ndarray], grid: list[tuple[float, float]], like: dict) -> dict[int, float]:
    """Mean loss per grid point on ``rows`` (one pass for the whole grid)."""
    df, bc = _head_losses(rows, thetas, grid, like)
    out = {r["key"]: r["loss"] / r["n"] for r in df.groupBy("key").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).collect()}
    bc.destroy()
    return out


def fit_head(train: DataFrame, evals: DataFrame, grid: list[tuple[float, float]], epochs: int = NUM_EPOCHS, batch_size: int = GLOBAL_BATCH_SIZE,
             patience: int = PATIENCE, drop: float = M.HEAD_DROP_PROB, seed: int = 42, hidden: int = M.HEAD_HIDDEN, id_col: str = "vec_id",
             eval_steps: int | None = None, tasks: int | None = None, init: Callable[[int], dict] | None = None) -> tuple[dict[tuple[float, float], dict], pd.DataFrame]:
    """M3 / M7: the head for each (learning rate, coefficient) of ``grid``, by ``epochs`` passes over the batches of ``train`` (id, x,
    input_r, label; rows without a label are left out) with Adam, warm-up and linear decay, and dropout before the last
    layer. ``evals`` is scored every ``eval_steps`` steps (None: after each epoch); a point stops after ``patience`` evaluations
    without strict improvement and keeps its best parameters. ``init`` gives the parameters to start from, for a number of
    features (None: seeded, with ``hidden`` units). Returns (best parameters per point, log of the evaluations
    with the mean training loss since the one before)."""
    tasks = tasks or dealt_over(batch_size, HEAD_TASK_ROWS)
    train = train.where(F.col("label").isNotNull())
    data = batches(train, id_col, [id_col, "x", "input_r", "label"], batch_size, "fit_order", tasks)
    ev = evals.where(F.col("label").isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    first = data.first()
    width = first["x"].shape[1] if first else 0
    like = init(width) if init else M.init_head(width, hidden, seed=seed)
    points = {k: Point(M.flatten(like), Adam(M.flatten(like))) for k in range(len(grid))}
    best = {k: (np.inf, p.theta.copy(), -1) for k, p in points.items()}
    schedule = {k: linear_warmup_decay(lr, data.steps * epochs) for k, (lr, _) in enumerate(grid)}
    bad, active, log = dict.fromkeys(points, 0), set(points) if data.n else set(), []
    for epoch in range(epochs):
        local, done = _head_local(grid, like, id_col, epoch, drop, seed), epoch * data.steps
        rates = _after(schedule, done)
        for run in data.runs(eval_steps, done) if active else ():
            points.update(run.take({k: points[k] for k in sorted(active)}, local, rates))
            taken = done + run.steps[-1] + 1
            if taken % eval_steps if eval_steps else run.steps[-1] < data.steps - 1:
                continue
            after = eval_losses(ev, {k: points[k].theta for k in active}, grid, like)
            for k in sorted(active):
                value, p = after.get(k, float("nan")), points[k]
                log.append((*grid[k], epoch, p.loss / p.n, value))
                p.n, p.loss = 0, 0.0
                if value < best[k][0]:
                    best[k], bad[k] = (value, p.theta.copy(), epoch), 0
                else:
                    bad[k] += 1
                    if bad[k] >= patience:
                        active.discard(k)
            if not active:
                break
    ev.unpersist()
    params = {grid[k]: dict(M.unflatten(t, like), best_epoch=epoch, best_eval_loss=loss) for k, (loss, t, epoch) in best.items()}
    return params, pd.DataFrame(log, columns=["learning_rate", "coefficient", "epoch", "train_loss", "eval_loss"])


def fit_calibration(ranked: DataFrame, batch_size: int = 1000, lr: float = CALIB_LR, epochs: int = 1, seed: int = 42, id_col: str = "row_id",
                    tasks: int | None = None) -> tuple[dict, pd.DataFrame]:
    """M4: SGD on the calibration layer over PIT-ranked rows (id, mean, stddev, q), in mini-batches of a seeded shuffle
    order. Returns (parameters, log of the epochs' mean squared errors, each batch's before its step)."""
    like = M.init_calibration(seed)
    points, log, columns = {0: Point(M.flatten(like), Descent())}, [], ["mean", "stddev", "q"]
    tasks = tasks or dealt_over(batch_size, CALIB_TASK_ROWS)
    data = batches(ranked.select(id_col, *columns), id_col, columns, batch_size, "calib_shuffle", tasks)

    def local(thetas, rows):
        return {0: M.calib_loss_grad(M.unflatten(thetas[0], like), *[rows[c].astype(float) for c in columns])}

    for epoch in range(epochs if data.n else 0):
        for run in data.runs():
            points = run.take(points, local, lambda k, step: lr)
        log.append((epoch, data.n, points[0].loss / data.n))
        points[0].n, points[0].loss = 0, 0.0
    return M.unflatten(points[0].theta, like), pd.DataFrame(log, columns=["epoch", "rows", "mse"])
