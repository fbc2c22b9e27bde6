"""Deterministic per-row randomness.

Uniforms come from a hash of ``(salt, id)``, never from ``rand()``: the value of a row does not
depend on partitioning, task retries or executor loss, so every recomputation is identical.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def uniform(salt: str, id_col, part: int = 0) -> Column:
    """u(salt, id) in [0, 1): the first 8 hex digits of md5(salt ':' id) over 2^32; ``part`` 1 to 3: the next eights, which
    are independent uniforms from the same digest."""
    idc = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.concat(F.lit(salt), F.lit(":"), idc.cast("string")))
    return F.conv(F.substring(digest, 1 + 8 * part, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def attach_r(id_col, seed: int = 42, upper_bound: float = 1.0) -> Column:
    """The random model input r, uniform in [0, upper_bound), fixed by seed and row id."""
    return uniform(f"r{seed}", id_col) * F.lit(float(upper_bound))
