"""String and timestamp helpers for run names, metric keys and stamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The templates of run names and metric keys in this module.


def py_run_name(seed: int, coefficient: float, lr: float, r_dim: int = 1, r_upper_bound: float = 1.0) -> str:
    """Run name with '.' replaced by '_' in coefficient and learning rate only."""
    return (
        f"seed_{seed}_coefficient_{str(coefficient).replace('.', '_')}_"
        f"lr_{str(lr).replace('.', '_')}_r_dim_{r_dim}_r_upper_bound_{r_upper_bound}_"
    )


def run_name(seed, coefficient_str, lr_str, r_dim=1, r_upper_bound="1.0") -> Column:
    """Column form: inputs are the printed (string) forms of the parameters."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(str(v))
    return F.concat(
        F.lit("seed_"), lit(seed), F.lit("_coefficient_"), F.replace(lit(coefficient_str), F.lit("."), F.lit("_")),
        F.lit("_lr_"), F.replace(lit(lr_str), F.lit("."), F.lit("_")), F.lit("_r_dim_"), lit(r_dim),
        F.lit("_r_upper_bound_"), lit(r_upper_bound), F.lit("_"),
    )


def metric_key(prefix: str, group, metric) -> Column:
    """``{prefix}_{group}_{metric}`` for group rows; the bare metric for the overall row."""
    from calibrix.config import OVERALL

    g = F.col(group) if isinstance(group, str) else group
    m = F.col(metric) if isinstance(metric, str) else metric
    return F.when(g == F.lit(OVERALL), m).otherwise(F.concat_ws("_", F.lit(prefix), g, m))


def with_prefix(prefix: str, key) -> Column:
    """Add ``prefix_`` to a key that does not already start with it."""
    k = F.col(key) if isinstance(key, str) else key
    return F.when(k.startswith(f"{prefix}_"), k).otherwise(F.concat(F.lit(f"{prefix}_"), k))


def stamp_day(ts) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy_MM_dd")


def stamp_minute(ts) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "HH_mm")
