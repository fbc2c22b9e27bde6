"""Helpers shared by the operators: Arrow maps over chosen columns, words, tables read from ``sf_dir``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Bytes of one text handled at a time where a text is cut into blocks of words.
BLOCK_BYTES = 1 << 20
# Rows of a batch that are handled at a time.
SLICE_ROWS = 500
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, as stored."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utf8(text: str | Column) -> Column:
    """A text's UTF-8 bytes, empty for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("binary"), F.lit(b"").cast("binary"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a bounded number of rows, so that what is made from one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``fn`` on every slice of Arrow batches; what it returns is cast to ``schema``."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield from pa.Table.from_batches([fn(batch)]).cast(arrow).to_batches()

    return df.mapInArrow(run, schema)


class Remembered[K, V](dict):
    """A bounded memory of ``make(key)``, in two generations of at most ``limit`` keys: when the young one is full it
    becomes the old one, and what is still asked for returns from there."""

    def __init__(self, make: Callable[[K], V], limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: K) -> V:
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def word_blocks(text: bytes, carry: int = 0, block: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Lists of the text's words (runs of other bytes than space and \\t to \\r), cut at white space
    after every ``block`` bytes, so that one very long text never becomes one list. From the second
    list on, each begins with the ``carry`` words before it."""
    if len(text) <= block:
        yield text.split()
        return
    at, last = 0, []
    while at < len(text):
        end = at + block
        cut = _SPACE.search(text, end) if end < len(text) else None
        end = cut.start() if cut else len(text)
        words = last + text[at:end].split()
        yield words
        last = words[-carry:] if carry else []
        at = end


def unused(name: str, columns: list[str]) -> str:
    """``name``, or it with underscores before it, as no column is called."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns: whatever else the input has can't clash with an operator's own names."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
