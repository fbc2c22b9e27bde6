"""Quality by a regularised quadratic discriminant over transformed document statistics.

A document's statistics are counted over its whole text and transformed so that they are nearer to normal: logarithms of sizes,
the arcsine of the root of shares (``FEATURES``). Each class of the labels has a mean and a covariance; the covariance is
shrunk to that of both classes together (``pooled``), and both to a multiple of the identity (``ridge``):

    S_k(pooled, ridge) = (1 - ridge) * ((1 - pooled) * S_k + pooled * S) + ridge * trace / d * I

on statistics scaled to variance 1. The score is the logistic function of the difference of the classes' log densities

    -(1/2) |W_k (x - m_k)|^2 - log det L_k + log prior_k,  S_k = L_k L_k',  W_k = L_k^-1

where the Cholesky factor and its inverse are computed once per fit and kept in the model that the tasks get.

Fitting covers every labelled row: tasks add up counts, sums and products of the statistics per class and fold (by a hash of the
id), Spark adds up the tasks, and one row per class, fold and entry reaches the driver, however many rows there are. The two
shrinkages are chosen from a grid by the log loss on folds that a model hasn't learnt from (sums of the others are differences
of sums, so that costs one more pass over the labelled rows' statistics).

Nulls: a null text scores as the empty text (all statistics 0); rows with a null id and null labels aren't learnt from, an id's
lowest label holds, and every row of an id is learnt from. Rows with a null id are scored, as not held out. Long texts are
counted whole. Ties between shrinkages go to the stronger one. Without labels of both classes every score is 0.5. Repeated
rows score alike, empty tables give empty results. Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.config import scratch_path
from calibrix.llm.common import map_batches, utf8

FOLDS, THRESHOLD = 5, 0.5
POOLED, RIDGE = (1.0, 0.5, 0.2, 0.1, 0.05, 0.02, 0.01), (0.3, 0.1, 0.03, 0.01, 0.003)
# Kinds of bytes whose shares are statistics; the last are those that begin a code point beyond ASCII.
KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".,;:", "calls": b"!?", "symbols": b"#*$%&|<>",
    "marks": b"\"'()+-/=@[\\]^_`{}~", "beyond": bytes(range(0xC0, 0x100)),
}
FEATURES = ["words", "word_size", "word_spread", "words_per_line", "line_repeats", "distinct_words", "commonest_word", "byte_entropy", *KINDS]
_KIND = np.zeros((256, len(KINDS)))
for _k, _bytes in enumerate(KINDS.values()):
    _KIND[list(_bytes), _k] = 1


def _stabilised(shares: np.ndarray) -> np.ndarray:
    return np.arcsin(np.sqrt(shares))


def transformed_statistics(text: bytes) -> np.ndarray:
    """``FEATURES`` of a text's UTF-8 bytes."""
    out = np.zeros(len(FEATURES))
    words = text.split()
    n = len(words)
    if not n:
        return out
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    sizes = np.fromiter(map(len, words), np.int64, n)
    times: dict[bytes, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    share = histogram[histogram > 0] / len(text)
    out[0], out[1], out[2], out[3] = np.log1p(n), np.log(sizes.mean()), np.log1p(sizes.std()), np.log(n / len(lines))
    out[4] = _stabilised(1 - len(set(lines)) / len(lines))
    out[5] = np.log(len(times)) / np.log(n) if n > 1 else 1.0
    out[6], out[7] = _stabilised(max(times.values()) / n), -(share * np.log(share)).sum()
    out[8:] = _stabilised(np.minimum(1.0, histogram @ _KIND / sizes.sum()))
    return out


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x``: each row's transformed statistics, as little-endian doubles, written once and read from there."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), utf8(F.col(f"`{text_col}`")).alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("x", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [transformed_statistics(t.as_buffer().to_pybytes()).astype("<f8").tobytes() for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], schema.names)

    path = scratch_path(docs.sparkSession, "quality_statistics", uuid.uuid4().hex)
    map_batches(src, run, schema).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = [v.as_buffer() for v in column]
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


@dataclass
class Moments:
    """Number, sum and sum of products of rows of statistics."""

    n: float
    total: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.total + other.total, self.products + other.products)

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.n - other.n, self.total - other.total, self.products - other.products)

    def mean(self) -> np.ndarray:
        return self.total / self.n

    def covariance(self) -> np.ndarray:
        m = self.mean()
        return self.products / self.n - np.outer(m, m)


@dataclass
class Discriminant:
    """The scale of the statistics, and per class the mean, the inverse Cholesky factor and the constant of the log density."""

    scale: np.ndarray
    means: np.ndarray
    inverses: np.ndarray
    constants: np.ndarray

    def difference(self, x: np.ndarray) -> np.ndarray:
        """How much higher the log density of class 1 is, for each row of statistics."""
        z = x / self.scale
        q = [-0.5 * (((z - m) @ w.T) ** 2).sum(1) + c for m, w, c in zip(self.means, self.inverses, self.constants, strict=True)]
        return q[1] - q[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.difference(x), -700, 700)))


def discriminant(classes: tuple[Moments, Moments], pooled: float, ridge: float) -> Discriminant:
    """The model of two classes' moments with given shrinkages."""
    both = classes[0] + classes[1]
    spread = np.sqrt(np.maximum(0.0, np.diag(both.covariance())))
    scale = np.where(spread > 1e-9, spread, 1.0)
    d, outer = len(scale), np.outer(scale, scale)
    within = sum(c.n * c.covariance() for c in classes) / both.n / outer
    means, inverses, constants = [], [], []
    for c in classes:
        s = (1 - pooled) * c.covariance() / outer + pooled * within
        s = (1 - ridge) * s + ridge * max(np.trace(s) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky((s + s.T) / 2)
        means.append(c.mean() / scale)
        inverses.append(np.linalg.inv(factor))
        constants.append(np.log(c.n / both.n) - np.log(np.diag(factor)).sum())
    return Discriminant(scale, np.array(means), np.array(inverses), np.array(constants))


def class_moments(rows: DataFrame, keys: tuple[str, ...] = ("y", "fold")) -> dict[tuple, Moments]:
    """Moments of ``x`` per combination of small numbers ``keys``: a row per combination and entry reaches the driver."""
    d = len(FEATURES)
    schema = T.StructType([*[T.StructField(k, T.IntegerType()) for k in keys], T.StructField("sums", T.ArrayType(T.DoubleType()))])

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            of = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], 1)
            for key in np.unique(of, axis=0):
                z = x[(of == key).all(1)]
                part = np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
                sums[tuple(key.tolist())] = sums.get(tuple(key.tolist()), 0) + part
        if sums:
            yield pa.RecordBatch.from_arrays([*[pa.array([s[k] for s in sums], pa.int32()) for k in range(len(keys))],
                                              pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], schema.names)

    parts = rows.select(*[F.col(k).cast("int").alias(k) for k in keys], "x").mapInArrow(run, schema)
    entries = parts.select(*keys, F.posexplode("sums").alias("at", "value")).groupBy(*keys, "at").agg(F.sum("value").alias("value"))
    out: dict[tuple, np.ndarray] = {}
    for r in entries.collect():  # 1 + d + d * d rows for each class and fold
        out.setdefault(tuple(r[k] for k in keys), np.zeros(1 + d + d * d))[r["at"]] = r["value"]
    return {k: Moments(v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in out.items()}


def chosen_shrinkage(rows: DataFrame, moments: dict[tuple, Moments]) -> tuple[float, float]:
    """The shrinkages with the least log loss over the folds, each scored by the model of the others."""
    total = [sum((m for (y, _), m in moments.items() if y == k), Moments(0, 0, 0)) for k in (0, 1)]
    grid = [(p, r) for p in POOLED for r in RIDGE]
    models = {}
    for fold in range(FOLDS):
        rest = tuple(total[k] - moments[k, fold] if (k, fold) in moments else total[k] for k in (0, 1))
        if min(m.n for m in rest) >= 2:
            models[fold] = [discriminant(rest, *g) for g in grid]
    if not models:
        return POOLED[0], RIDGE[0]
    shared = rows.sparkSession.sparkContext.broadcast(models)  # FOLDS models a grid point

    def run(batches):
        loss = np.zeros(len(grid))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, of = _matrix(batch.column("x")), *(batch.column(k).to_numpy(zero_copy_only=False) for k in ("y", "fold"))
            for fold, points in shared.value.items():
                mine = of == fold
                if mine.any():
                    sign = np.where(y[mine] == 1, -1.0, 1.0)
                    loss += [np.logaddexp(0, sign * m.difference(x[mine])).sum() for m in points]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(grid)), pa.int32()), pa.array(loss)], ["point", "loss"])

    found = rows.select("x", F.col("y").cast("int").alias("y"), "fold").mapInArrow(run, "point int, loss double")
    losses = {r["point"]: r["loss"] for r in found.groupBy("point").agg(F.sum("loss").alias("loss")).collect()}
    return grid[min(losses, key=lambda k: (losses[k], k))]


def held_out(id_col: str = "doc_id"):
    """Whether a row is never learnt from: crc32 of its id as text leaves 1 on division by 3."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1


def fit_discriminant(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Discriminant | None:
    """The model from all labelled rows of ``statistics`` (of ``statistics_table``) that aren't held out; none without both classes."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.where(~held_out() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = statistics.join(known, "doc_id").withColumn("fold", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FOLDS)).cast("int"))
    path = scratch_path(statistics.sparkSession, "quality_labelled", uuid.uuid4().hex)
    rows.select("x", "y", "fold").write.parquet(path)
    rows = statistics.sparkSession.read.parquet(path)
    moments = class_moments(rows)
    classes = tuple(sum((m for (y, _), m in moments.items() if y == k), Moments(0, 0, 0)) for k in (0, 1))
    if min(c.n for c in classes) < 1:
        return None
    return discriminant(classes, *chosen_shrinkage(rows, moments))


def quality_scores(statistics: DataFrame, model: Discriminant | None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per row of ``statistics``."""
    shared = statistics.sparkSession.sparkContext.broadcast(model)  # two matrices of the statistics' number
    schema = T.StructType([statistics.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                model = shared.value
                score = model.scores(_matrix(batch.column("x"))) if model else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], schema.names)

    out = statistics.select("doc_id", "x").mapInArrow(run, schema)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
