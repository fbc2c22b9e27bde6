"""Average calibration: PIT ranks against the uniform grid, and the calibration error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrix.config import PIT_CLIP
from calibrix.functions.math import clamp, with_normal_cdf
from calibrix.operators.ranking import global_rank


def pit_rank(fc: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Sort by PIT, pair the i-th row with linspace(0, 1, n)[i]; PIT clipped to [1e-6, 1 - 1e-6].

    ``q = (rank - 1) / (n - 1)`` with ``rank`` exact and ties broken by id (``percent_rank``
    would merge ties). ``n = 1`` gives q = 0. Rows without a label have no PIT and are left out.
    """
    t = with_normal_cdf(fc.where(F.col("label").isNotNull()), "_pit")
    r = global_rank(t, "_pit", id_col, out="pos", total="_n")
    q = F.when(F.col("_n") > 1, (F.col("pos") - 1) / (F.col("_n") - 1).cast("double")).otherwise(F.lit(0.0))
    return r.select(*[c for c in r.columns if c != "_n"], q.alias("q"), clamp("_pit", PIT_CLIP, 1.0 - PIT_CLIP).alias("cdf"))


def calibration_mse(ranked: DataFrame, mean: str = "mean", stddev: str = "stddev") -> DataFrame:
    """mean of (Phi((q - mean') / stddev') - q)^2, and the PIT-vs-grid error next to it."""
    return with_normal_cdf(ranked, "_phi", "q", mean, stddev).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.pow(F.col("_phi") - F.col("q"), 2)).alias("mse"),
        F.avg(F.pow(F.col("cdf") - F.col("q"), 2)).alias("pit_grid_mse"),
    )
