"""Writes that count once: data goes to a folder of its own, a small record names it, and readers see recorded folders only.

A table at ``path`` has ``data/part=<name>/`` and ``commits/<digest of the key>.json``. A write with a key first fills a new part,
then publishes its record by one rename that fails if the key has one already. So a write that is repeated, runs twice at
the same time or dies half-way adds its rows once or not at all, and a part without a record is never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrix.config import path_exists

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("length", T.LongType()), T.StructField("modified", T.LongType())])
RECORD = T.StructType([T.StructField("key", T.StringType()), T.StructField("part", T.StringType()), T.StructField("files", T.ArrayType(FILE))])


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _record_path(path: str, key: str) -> str:
    return f"{path}/commits/{hashlib.sha256(key.encode()).hexdigest()[:32]}.json"


def _read_text(spark: SparkSession, path: str) -> str:
    jvm, p, fs = _files(spark, path)
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def committed(spark: SparkSession, path: str, key: str) -> dict | None:
    """The record of ``key``, if it has one."""
    at = _record_path(path, key)
    return json.loads(_read_text(spark, at)) if path_exists(spark, at) else None


def commit(spark: SparkSession, path: str, key: str, part: str, files: list[dict] | None = None) -> dict:
    """Publish ``part`` as the data of ``key``; returns the record that holds, which is another writer's if that came first."""
    at = _record_path(path, key)
    jvm, target, fs = _files(spark, at)
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}/commits/_{uuid.uuid4().hex}")
    out = fs.create(temporary, False)
    out.write(json.dumps({"key": key, "part": part, "files": files or []}).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        # Fails if there's a record already, unlike a plain rename of some file systems.
        context.rename(fs.makeQualified(temporary), fs.makeQualified(target), spark.sparkContext._gateway.new_array(kind, 0))
    except Exception:
        if not fs.exists(target):
            raise
        fs.delete(temporary, False)
    return json.loads(_read_text(spark, at))


def part_path(path: str, part: str) -> str:
    return f"{path}/data/part={part}"


def append_once(df: DataFrame, path: str, key: str, partition_by: list[str] | None = None, files: list[dict] | None = None) -> bool:
    """Add ``df`` to the table under ``key``; False, without a change, if the key has been added before."""
    spark = df.sparkSession
    if committed(spark, path, key):
        return False
    part = uuid.uuid4().hex
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(part_path(path, part))
    return commit(spark, path, key, part, files)["part"] == part


def records(spark: SparkSession, path: str) -> DataFrame:
    """The table's records: ``key, part, files``."""
    if not path_exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).option("pathGlobFilter", "*.json").json(f"{path}/commits")


def read_committed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of the recorded parts: parts are folders, so those without a record are pruned before they are read."""
    if not path_exists(spark, f"{path}/data"):
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("part", T.StringType())])
    rows = spark.read.schema(full).option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.join(records(spark, path).select("part"), "part", "left_semi").select(*schema.names)


def build_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], key: str = "build") -> DataFrame:
    """The table that ``build`` makes, made once: a reader gets the recorded build or makes one; of several at the same time the
    first to finish holds, and all read that."""
    record = committed(spark, path, key)
    if record is None:
        part = uuid.uuid4().hex
        build().write.parquet(part_path(path, part))
        record = commit(spark, path, key, part)
    return spark.read.parquet(part_path(path, record["part"]))


def new_files(spark: SparkSession, path: str, source: str, pattern: str = "*.parquet") -> list[dict]:
    """Files at ``source`` (``path, length, modified``) that no record of the table at ``path`` names. A row per new file."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(source)
    listed = listed.select("path", "length", F.unix_millis("modificationTime").alias("modified"))
    known = records(spark, path).select(F.explode("files").alias("f")).select("f.*")
    return [r.asDict() for r in listed.join(known, ["path", "length", "modified"], "left_anti").orderBy("modified", "path").collect()]
