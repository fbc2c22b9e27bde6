"""Column-expression functions (all JVM-side, codegen-friendly)."""

from calibrix.functions.math import (
    clamp,
    gaussian_nll,
    leaky_relu,
    normal_cdf,
    relu,
    sample_normal,
    sigmoid,
    sigmoid_stddev,
)
from calibrix.functions.random import attach_r, uniform
from calibrix.functions.strings import metric_key, run_name, stamp_day, stamp_minute

__all__ = [
    "attach_r",
    "clamp",
    "gaussian_nll",
    "leaky_relu",
    "metric_key",
    "normal_cdf",
    "relu",
    "run_name",
    "sample_normal",
    "sigmoid",
    "sigmoid_stddev",
    "stamp_day",
    "stamp_minute",
    "uniform",
]
