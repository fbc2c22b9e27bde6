"""File-stream sources staged from batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stage_in_order(df: DataFrame, path: str, order_col: str, files: int = 16, reverse: bool = False) -> int:
    """Write ``df`` under ``path`` in at most ``files`` files by ranges of ``order_col``, and return their number.

    One write, range-partitioned: equal values share a file. A file source takes new files by their modification time,
    so that of each file is then set by its range (``reverse``: latest first, a source of late data).
    """
    key = df[order_col].desc() if reverse else df[order_col].asc()
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.parquet(path)
    jvm = df.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    first = fs.getFileStatus(folder).getModificationTime() - 1000 * len(parts)
    for i, p in enumerate(parts):
        fs.setTimes(p, first + 1000 * i, -1)
    return len(parts)
