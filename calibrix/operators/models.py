"""Scoring models as Spark jobs: the Gaussian head (M1, M8) and the calibration layer (M2).

The head maps ``[features, r] -> fc1 -> leaky -> [h, r] -> fc2 -> leaky -> fc3 -> (mean, stddev)``
with ``stddev = sigmoid(.) * 5 + 0.01``. Its input is a precomputed embedding column; the text
encoder itself is out of scope. Parameters are a few thousand numbers: they are broadcast, and
each Arrow batch is scored with numpy inside ``mapInPandas`` (no per-row Python).

The calibration layer (``2 -> 16 relu -> 2``) is small enough to be plain column expressions, so
it stays inside whole-stage codegen and is checked against SQL.

Forward and backward passes live here as numpy functions over one batch; ``fitting`` sums the
per-batch gradients across the cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrix.config import DEFAULT_SEED
from calibrix.functions.math import ERF_COEFFICIENTS, HALF_LOG_2PI
from calibrix.functions.random import attach_r

# Head width, dropout share, calibration hidden width, stddev scale and floor.
HEAD_HIDDEN = 100
HEAD_DROP_PROB = 0.5
CALIB_HIDDEN = 16
STD_SCALE = 5.0
STD_FLOOR = 0.01
LEAKY_SLOPE = 0.01
# The embedding table's labels are 0 to 9; the head's target is in [0, 1].
LABEL_SCALE = 9.0

SCORE_SCHEMA = "mean double, stddev double"


# ------------------------------------------------------------------ parameters
def _linear(rng: np.random.Generator, n_out: int, n_in: int) -> tuple[np.ndarray, np.ndarray]:
    bound = 1.0 / np.sqrt(n_in)
    return rng.uniform(-bound, bound, (n_out, n_in)), rng.uniform(-bound, bound, n_out)


def init_head(dim: int, hidden: int = HEAD_HIDDEN, r_dim: int = 1, seed: int = DEFAULT_SEED) -> dict:
    """Seeded uniform(+-1/sqrt(fan_in)) initialisation of the three head layers."""
    rng = np.random.default_rng(seed)
    w1, b1 = _linear(rng, hidden, dim + r_dim)
    w2, b2 = _linear(rng, hidden, hidden + r_dim)
    w3, b3 = _linear(rng, 2, hidden)
    return {"w1": w1, "b1": b1, "w2": w2, "b2": b2, "w3": w3, "b3": b3, "r_dim": r_dim}


def init_calibration(seed: int = DEFAULT_SEED, hidden: int = CALIB_HIDDEN) -> dict:
    rng = np.random.default_rng(seed + 1)
    w1, b1 = _linear(rng, hidden, 2)
    w2, b2 = _linear(rng, 2, hidden)
    return {"w1": w1, "b1": b1, "w2": w2, "b2": b2}


PARAM_KEYS = ("w1", "b1", "w2", "b2", "w3", "b3")


def flatten(p: dict) -> np.ndarray:
    return np.concatenate([np.ravel(p[k]) for k in PARAM_KEYS if k in p])


def unflatten(theta: np.ndarray, like: dict) -> dict:
    out, i = {}, 0
    for k in PARAM_KEYS:
        if k in like:
            n = like[k].size
            out[k] = theta[i:i + n].reshape(like[k].shape)
            i += n
    for k, v in like.items():
        if k not in out:
            out[k] = v
    return out


# ------------------------------------------------------------------ numpy math (one batch)
def np_erf(x: np.ndarray) -> np.ndarray:
    """The same polynomial as the column ``erf`` (so numpy and SQL paths agree)."""
    ax = np.abs(x)
    u = 4.0 / (2.0 + ax) - 1.0
    y = 1.0 - (u + 1.0) / 2.0 * np.exp(np.polynomial.polynomial.polyval(u, ERF_COEFFICIENTS) - ax * ax)
    return np.where(x < 0, -y, y)


def np_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np_erf(z / np.sqrt(2.0)))


def np_pdf(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / np.sqrt(2.0 * np.pi)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


def _leaky(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x, LEAKY_SLOPE * x)


def dropout_mask(ids: np.ndarray, width: int, epoch: int, share: float = HEAD_DROP_PROB, seed: int = DEFAULT_SEED) -> np.ndarray:
    """[n, width] factors: 0 for a share of a row's units, 1 / (1 - share) for the others, by a hash of (seed, epoch, row id,
    unit): the same in any partitioning."""
    units = np.arange(width, dtype=np.uint64) + np.uint64((seed * 1_000_003 + epoch) * width)
    h = (ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (units * np.uint64(0xD1B54A32D192ED03))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    u = (h >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.where(u < share, 0.0, 1.0 / (1.0 - share))


def head_forward(p: dict, x: np.ndarray, r: np.ndarray, cache: bool = False, mask: np.ndarray | float = 1.0):
    """``x``: [n, d] features, ``r``: [n] -> (mean [n], stddev [n]); ``mask``: dropout factors of the second hidden layer
    (1 in evaluation mode)."""
    rr = np.repeat(r[:, None], p["r_dim"], axis=1)
    h0 = np.hstack([x, rr])
    a1 = h0 @ p["w1"].T + p["b1"]
    h1c = np.hstack([_leaky(a1), rr])
    a2 = h1c @ p["w2"].T + p["b2"]
    h2 = _leaky(a2) * mask
    o = h2 @ p["w3"].T + p["b3"]
    s = _sigmoid(o[:, 1])
    mean, std = o[:, 0], s * STD_SCALE + STD_FLOOR
    if cache:
        return mean, std, (h0, a1, h1c, a2, h2, s)
    return mean, std


def loss_terms(y: np.ndarray, r: np.ndarray, mean: np.ndarray, std: np.ndarray, alpha: float):
    """Per-row loss ``(1 - a)|Phi(z) - r| + a * nll`` and its derivatives in mean and stddev."""
    z = (y - mean) / std
    gap = np_cdf(z) - r
    nll = np.log(std) + HALF_LOG_2PI + 0.5 * z * z
    loss = (1.0 - alpha) * np.abs(gap) + alpha * nll
    dcdf = np.sign(gap) * np_pdf(z)
    d_mean = (1.0 - alpha) * dcdf * (-1.0 / std) + alpha * (-z / std)
    d_std = (1.0 - alpha) * dcdf * (-z / std) + alpha * (1.0 / std - z * z / std)
    return loss, d_mean, d_std


def head_loss_grad(p: dict, x: np.ndarray, r: np.ndarray, y: np.ndarray, alpha: float, mask: np.ndarray | float = 1.0):
    """Sum of per-row losses over the batch and the gradient of that sum (flat, PARAM_KEYS order)."""
    mean, std, (h0, a1, h1c, a2, h2, s) = head_forward(p, x, r, cache=True, mask=mask)
    loss, d_mean, d_std = loss_terms(y, r, mean, std, alpha)
    do = np.stack([d_mean, d_std * STD_SCALE * s * (1.0 - s)], axis=1)
    g = {"w3": do.T @ h2, "b3": do.sum(0)}
    da2 = (do @ p["w3"]) * mask * np.where(a2 > 0, 1.0, LEAKY_SLOPE)
    g["w2"], g["b2"] = da2.T @ h1c, da2.sum(0)
    hidden = p["w1"].shape[0]
    da1 = (da2 @ p["w2"])[:, :hidden] * np.where(a1 > 0, 1.0, LEAKY_SLOPE)
    g["w1"], g["b1"] = da1.T @ h0, da1.sum(0)
    return float(loss.sum()), flatten(g)


def calib_forward(p: dict, mean: np.ndarray, std: np.ndarray, cache: bool = False):
    h = np.stack([mean, std], axis=1)
    a1 = h @ p["w1"].T + p["b1"]
    r1 = np.maximum(a1, 0.0)
    o = r1 @ p["w2"].T + p["b2"]
    s = _sigmoid(o[:, 1])
    m2, s2 = o[:, 0], s * STD_SCALE + STD_FLOOR
    if cache:
        return m2, s2, (h, a1, r1, s)
    return m2, s2


def calib_loss_grad(p: dict, mean: np.ndarray, std: np.ndarray, q: np.ndarray):
    """Sum over the batch of ``(Phi((q - mean') / stddev') - q)^2`` and its gradient."""
    m2, s2, (h, a1, r1, s) = calib_forward(p, mean, std, cache=True)
    z = (q - m2) / s2
    e = np_cdf(z) - q
    de = 2.0 * e * np_pdf(z)
    do = np.stack([de * (-1.0 / s2), de * (-z / s2) * STD_SCALE * s * (1.0 - s)], axis=1)
    g = {"w2": do.T @ r1, "b2": do.sum(0)}
    da1 = (do @ p["w2"]) * (a1 > 0)
    g["w1"], g["b1"] = da1.T @ h, da1.sum(0)
    return float((e * e).sum()), flatten(g)


# ------------------------------------------------------------------ Spark wrappers
def features(emb: DataFrame, seed: int = DEFAULT_SEED, r_upper_bound: float = 1.0, id_col: str = "vec_id",
             label_col: str | None = "label", label_scale: float = LABEL_SCALE) -> DataFrame:
    """``(id, x array<double>, input_r, label)``: embedding as doubles, hash-seeded ``r``, and the
    label scaled to [0, 1] (null stays null)."""
    cols = [F.col(id_col), F.transform("embedding", lambda v: v.cast("double")).alias("x"),
            attach_r(id_col, seed, r_upper_bound).alias("input_r")]
    if label_col:
        cols.append((F.col(label_col).cast("double") / F.lit(label_scale)).alias("label"))
    return emb.select(*cols)


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()) if len(col) else np.zeros((0, 0))


def score_head(feats: DataFrame, params: dict, keep: list[str] | None = None) -> DataFrame:
    """M1: ``feats`` rows plus ``mean, stddev`` from the head, scored per Arrow batch."""
    spark = feats.sparkSession
    bc = spark.sparkContext.broadcast(params)
    keep = keep if keep is not None else [c for c in feats.columns if c != "x"]
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in feats.schema.fields if f.name in keep)
    out_schema += ", mean double, stddev double"

    def run(batches):
        p = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            mean, std = head_forward(p, _stack(pdf["x"]), pdf["input_r"].to_numpy(dtype=float))
            out = pdf[keep].copy()
            out["mean"], out["stddev"] = mean, std
            yield out

    return feats.mapInPandas(run, out_schema)


def head_sql(p: dict, source: str) -> list[str]:
    """CTEs ending in ``scored``: the head over ``source`` (vec_id, x, input_r, label) as SQL lists, for the oracle."""
    def numbers(a: np.ndarray) -> str:
        return "[" + ", ".join(f"{float(v)!r}" for v in a) + "]::DOUBLE[]"

    def matrix(a: np.ndarray) -> str:
        return "[" + ", ".join("[" + ", ".join(f"{float(v)!r}" for v in row) + "]" for row in a) + "]::DOUBLE[][]"

    def layer(w: str, b: str, h: str) -> str:
        return f"list_transform(range(1, len({b}) + 1), lambda j: list_dot_product({w}[j], {h}) + {b}[j])"

    def leaky(h: str) -> str:
        return f"list_transform({h}, lambda v: CASE WHEN v > 0 THEN v ELSE {LEAKY_SLOPE!r}::DOUBLE * v END)"

    r = "list_transform(range(0, r_dim), lambda i: input_r)"
    params = ", ".join([*(f"{matrix(p[k])} AS {k}" for k in ("w1", "w2", "w3")), *(f"{numbers(p[k])} AS {k}" for k in ("b1", "b2", "b3")),
                        f"{p['r_dim']} AS r_dim"])
    return [
        f"head AS MATERIALIZED (SELECT {params})",
        f"head1 AS (SELECT vec_id, label, input_r, {leaky(layer('w1', 'b1', f'list_concat(x, {r})'))} AS h FROM {source}, head)",
        f"head2 AS (SELECT vec_id, label, input_r, {leaky(layer('w2', 'b2', f'list_concat(h, {r})'))} AS h FROM head1, head)",
        f"head3 AS (SELECT vec_id, label, input_r, {layer('w3', 'b3', 'h')} AS o FROM head2, head)",
        f"scored AS (SELECT vec_id, label, input_r, o[1] AS mean, 1.0::DOUBLE / (1.0::DOUBLE + exp(-o[2])) * {STD_SCALE!r}::DOUBLE + "
        f"{STD_FLOOR!r}::DOUBLE AS stddev FROM head3)",
    ]


def _hidden_columns(p: dict, mean: str, stddev: str) -> list[Column]:
    m, s = F.col(mean), F.col(stddev)
    return [F.greatest(F.lit(float(p["w1"][j, 0])) * m + F.lit(float(p["w1"][j, 1])) * s + F.lit(float(p["b1"][j])),
                       F.lit(0.0)) for j in range(p["w1"].shape[0])]


def _output_columns(p: dict, hidden: list[Column]) -> tuple[Column, Column]:
    def out(k: int) -> Column:
        acc = F.lit(float(p["b2"][k]))
        for j, h in enumerate(hidden):
            acc = acc + F.lit(float(p["w2"][k, j])) * h
        return acc

    std2 = F.lit(1.0) / (F.lit(1.0) + F.exp(-out(1))) * F.lit(STD_SCALE) + F.lit(STD_FLOOR)
    return out(0), std2


def calibrated_columns(p: dict, mean: str = "mean", stddev: str = "stddev") -> tuple[Column, Column]:
    """M2 as column expressions: ``(mean', stddev')`` (inline form, for use inside other selects)."""
    return _output_columns(p, _hidden_columns(p, mean, stddev))


def calibrated_sql(p: dict, mean: str = "mean", stddev: str = "stddev") -> tuple[str, str]:
    """The same M2 expressions as SQL text (for the oracle)."""
    def lit(v: float) -> str:
        return f"({float(v)!r}::DOUBLE)"

    hidden = [f"greatest({lit(p['w1'][j, 0])} * {mean} + {lit(p['w1'][j, 1])} * {stddev} + {lit(p['b1'][j])}, 0.0::DOUBLE)"
              for j in range(p["w1"].shape[0])]

    def out(k: int) -> str:
        acc = lit(p["b2"][k])
        for j, h in enumerate(hidden):
            acc = f"({acc} + {lit(p['w2'][k, j])} * {h})"
        return acc

    std2 = f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-{out(1)})) * {lit(STD_SCALE)} + {lit(STD_FLOOR)})"
    return out(0), std2


def score_calibrated(fc: DataFrame, p: dict) -> DataFrame:
    """M2 over stored forecasts: replaces ``mean, stddev`` by the calibrated pair.

    The hidden units are projected as their own columns first: each is read by both outputs, so
    the optimizer keeps them as one projection instead of inlining 16 copies into every use of
    the outputs (which would overflow the generated code and leave whole-stage codegen).
    """
    hidden = _hidden_columns(p, "mean", "stddev")
    names = [f"_cal_h{j}" for j in range(len(hidden))]
    h = fc.select("*", *[c.alias(n) for c, n in zip(hidden, names)])
    m2, s2 = _output_columns(p, [F.col(n) for n in names])
    others = [c for c in fc.columns if c not in ("mean", "stddev")]
    return h.select(*others, m2.alias("mean"), s2.alias("stddev"))
