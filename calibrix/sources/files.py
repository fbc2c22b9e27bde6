"""File sources and sinks: CSV with an explicit schema (read by byte ranges, ``quoted_csv``), partitioned split tables, cached builds,
append-only logs. All paths live in the shared checkpoint folder (``config.scratch_path``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.config import GROUPS, fresh_path
from calibrix.sources.commits import build_once
from calibrix.sources.quoted_csv import read_quoted_csv

COMMENT_SCHEMA = T.StructType(
    [T.StructField(g, T.DoubleType(), True) for g in GROUPS]
    + [
        T.StructField("id", T.LongType(), True),
        T.StructField("target", T.DoubleType(), True),
        T.StructField("comment_text", T.StringType(), True),
    ]
)

# Quoting that round-trips multi-line text with embedded quotes and edge whitespace, as ``quoted_csv`` reads it.
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_comments_csv(spark: SparkSession, path: str, schema: T.StructType = COMMENT_SCHEMA, split_bytes: int | None = None,
                      damaged: str | None = None) -> DataFrame:
    """Raw comment CSV with a fixed schema (no inference pass over the data), a file by any number of tasks. ``damaged`` names a
    column with the text of rows that don't fit the schema."""
    return read_quoted_csv(spark, path, schema, split_bytes, damaged=damaged)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One table partitioned by ``split`` (train/calib/eval/test directories)."""
    w = df.write.mode("overwrite").partitionBy("split")
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Read the split table; only the directory of ``split`` is read, if one is given. CSV needs the columns' schema."""
    if fmt == "csv":
        schema = T.StructType([*schema.fields, T.StructField("split", T.StringType())])
        return read_quoted_csv(spark, f"{path}/split={split}" if split else path, schema, damaged=None, folders=("split",))
    df = spark.read.parquet(path)
    return df.where(df["split"] == split) if split else df


def input_listing(spark: SparkSession, *paths: str) -> str:
    """A digest of the files at ``paths`` (path, length, modification time): part of a cache key, so that new data in
    the same folder isn't taken for the old. Lists files only, as a Spark job; their contents aren't read."""
    parts = []
    for p in paths:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p)
        row = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
        parts.append(f"{p}:{row[0]}:{row[1]}")
    return "|".join(parts)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built if it isn't there. A build fills a folder of its own and is published by one rename; of several
    at the same time the first to finish holds and all read that.

    The path must name the inputs and the code (``scratch_path`` with ``input_listing`` and ``code_fingerprint``).
    """
    return build_once(spark, path, build)


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table of its own, bucketed and sorted by ``key`` (a file a bucket): tables with the same key and number of
    buckets join on it without a shuffle."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = f"{name}_{path.rsplit('/', 1)[-1]}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table under the shared checkpoint folder and read it back.

    For small intermediate results read by several branches of a plan: the branches then scan
    the written table instead of each re-deriving it from the source (which the optimizer cannot
    share once column pruning has made the branches differ). Runs one job.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)
