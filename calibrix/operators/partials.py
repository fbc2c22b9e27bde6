"""An evaluation in parts that are kept. Sufficient statistics (counts and sums per group) of every few input files are
stored under a commit record that names the files; a run that was interrupted goes on where it stopped, and one over a folder
with new files reads those only. The final result is a sum over the stored parts, a row per part and group."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.operators.groups import with_scopes
from calibrix.operators.losses import forecast_terms
from calibrix.sources import commits as C

LOSS_STATISTICS = T.StructType([T.StructField("group", T.StringType()), T.StructField("n", T.LongType()), T.StructField("s_cdf", T.DoubleType()),
                                T.StructField("s_nll", T.DoubleType()), T.StructField("s_std", T.DoubleType())])


def loss_statistics(forecasts: DataFrame) -> DataFrame:
    """Numbers and sums of the losses of all forecasts and of each group's members, from which their means follow."""
    scopes = with_scopes(forecast_terms(forecasts), ["cdf_gap", "nll", "stddev"])
    return scopes.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("cdf_gap").alias("s_cdf"), F.sum("nll").alias("s_nll"),
                                       F.sum("stddev").alias("s_std"))


def flush_partials(spark: SparkSession, source: str, store: str, statistics: Callable[[DataFrame], DataFrame] = loss_statistics,
                   files_per_flush: int = 8, schema: T.StructType | None = None) -> int:
    """Store the statistics of the files at ``source`` that the store doesn't have, ``files_per_flush`` files at a time; the number of
    flushes. A flush that fails leaves those before it in place."""
    todo = C.new_files(spark, store, source)
    flushes = [todo[i:i + files_per_flush] for i in range(0, len(todo), files_per_flush)]
    for files in flushes:
        key = hashlib.sha256(json.dumps(files, sort_keys=True).encode()).hexdigest()
        reader = spark.read.schema(schema) if schema else spark.read
        rows = statistics(reader.parquet(*[f["path"] for f in files]))
        C.append_once(rows.coalesce(1), store, key, files=files)
    return len(flushes)


def final_losses(spark: SparkSession, store: str) -> DataFrame:
    """``group, n, loss_cdf, loss_nll, loss_stddev`` over everything stored so far."""
    parts = C.read_committed(spark, store, LOSS_STATISTICS)
    total = parts.groupBy("group").agg(*[F.sum(c).alias(c) for c in ("n", "s_cdf", "s_nll", "s_std")])
    return total.select("group", "n", *[(F.col(s) / F.col("n")).alias(c) for s, c in (("s_cdf", "loss_cdf"), ("s_nll", "loss_nll"), ("s_std", "loss_stddev"))])
