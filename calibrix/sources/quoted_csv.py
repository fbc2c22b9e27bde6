"""Quoted CSV read in parallel: any number of tasks a file, line breaks and doubled quotes inside quoted fields.

A byte range of such a file can't be told to begin inside or outside quotes by itself, so ranges are read twice:

1. Each range is moved to the line breaks after its ends. At such a place the parser is in one of two states: at the start of a
   record, or inside quotes. A task scans its range from both and tells in which state each ends (``ends``).
2. The ranges of a file are put together in order: the state at a range's start is what the range before ends in, from a
   record's start at the first (``starts``). That is a pass over one small row per range.
3. A range's records are those that start in it. With the state known, the first record's start is found (``first_record``);
   the range is read from there up to the next range's first record, which may lie further on.

The last step is a Python data source (``quoted_csv``) with a partition per range that isn't empty. Rows whose fields don't fit the schema
(too few or too many fields, a value that isn't of its column's type, a line break of another kind outside quotes) keep what
fits, null for the rest, and hold their text in the column ``damaged``, if the schema has it.

Fields are separated by commas, records by ``\\n`` (or ``\\r\\n``). A field in quotes may hold commas, line breaks and quotes (doubled); what
follows its closing quote up to the comma belongs to it; quotes inside a field without are text. An empty field is null, ``""``
the empty text. Files are read through ``pyarrow.fs`` by URI. Empty lines have no record. Folders ``column=value`` below the
path give columns of the schema.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from calibrix.config import fresh_path

DAMAGED = "_damaged"
# States at a line break: at the start of a record, inside quotes.
OUTSIDE, INSIDE = 0, 1
_CLOSE = re.compile(rb'[^"]*+(?:""[^"]*+)*+"')
_OPEN = re.compile(rb'[,\n]"')
_STEP = 1 << 20
# Rows of a batch, and bytes from which one is passed on earlier.
_ROWS, _BYTES = 10_000, 16 << 20


# ------------------------------------------------------------------ files
def _opened(uri: str):
    """A file by URI, for reading at any place."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(parts.path))
    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return store.open_input_file(path)


def _pieces(f, at: int, end: int, step: int = _STEP) -> Iterator[bytes]:
    f.seek(at)
    while at < end:
        piece = f.read(min(step, end - at))
        if not piece:
            return
        yield piece
        at += len(piece)


def line_start(f, at: int, size: int) -> int:
    """The first place from ``at`` on that begins a line; the file's size if none does."""
    if at <= 0:
        return 0
    place = at - 1
    for piece in _pieces(f, place, size):
        found = piece.find(b"\n")
        if found >= 0:
            return place + found + 1
        place += len(piece)
    return size


class Scanner:
    """The parser's state behind the bytes given so far, in pieces; started at a line's start."""

    def __init__(self, state: int):
        # Inside quotes, or outside with the byte before; a quote that ends a piece may close the field or be half of a double.
        self.inside, self.before, self.half = state == INSIDE, b"\n", False

    def feed(self, data: bytes, stop: bool = False) -> int | None:
        """Take ``data``; with ``stop``, the number of bytes up to the first record's end in it, if it has one."""
        at = 0
        while at < len(data):
            if self.inside:
                if self.half:
                    self.half = False
                    if data[at : at + 1] == b'"':
                        at += 1
                    else:
                        self.inside, self.before = False, b'"'
                        continue
                closed = _CLOSE.match(data, at)
                if closed and closed.end() < len(data):
                    at, self.inside, self.before = closed.end(), False, b'"'
                    continue
                # No closing quote, or one that may be doubled by the next piece's first byte.
                rest = data[at:]
                self.half = (len(rest) - len(rest.rstrip(b'"'))) % 2 == 1
                return None
            if self.before in b",\n" and data[at : at + 1] == b'"':
                at, self.inside, self.before = at + 1, True, b""
                continue
            opened = _OPEN.search(data, at)
            if stop:
                end = data.find(b"\n", at, opened.start() + 1 if opened else len(data))
                if end >= 0:
                    return end + 1
            if not opened:
                self.before = data[-1:]
                return None
            at, self.inside, self.before = opened.end(), True, b""
        return None

    def state(self) -> int:
        """At a line's start."""
        return INSIDE if self.inside and not self.half else OUTSIDE


def ends(f, first: int, last: int) -> tuple[int, int]:
    """The states that the bytes between two lines' starts lead to, from outside and from inside quotes."""
    scanners = [Scanner(OUTSIDE), Scanner(INSIDE)]
    for piece in _pieces(f, first, last):
        for s in scanners:
            s.feed(piece)
    return scanners[0].state(), scanners[1].state()


def first_record(f, at: int, state: int, size: int) -> int:
    """The first record's start from a line's start on; the file's size if there's none."""
    if state == OUTSIDE or at >= size:
        return at
    scanner, place = Scanner(state), at
    for piece in _pieces(f, at, size):
        found = scanner.feed(piece, stop=True)
        if found is not None:
            return place + found
        place += len(piece)
    return size


# ------------------------------------------------------------------ ranges
_RANGE = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("first", T.LongType()),
                       T.StructField("last", T.LongType()), T.StructField("from_outside", T.IntegerType()), T.StructField("from_inside", T.IntegerType())])
_START = T.StructType([*_RANGE.fields[:4], T.StructField("first_state", T.IntegerType()), T.StructField("last_state", T.IntegerType())])


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with _opened(r["path"]) as f:
                first, last = (line_start(f, at, r["size"]) for at in (r["at"], min(r["size"], r["at"] + r["bytes"])))
                row = (r["path"], r["size"], first, last, *ends(f, first, last))
            yield pa.RecordBatch.from_pylist([dict(zip(_RANGE.names, row, strict=True))], to_arrow_schema(_RANGE))


def starts(ranges: pa.Table) -> pa.Table:
    """The states at both ends of a file's ranges that aren't empty."""
    state, rows = OUTSIDE, []
    for r in sorted(ranges.to_pylist(), key=lambda r: (r["first"], r["last"])):
        if r["first"] < r["last"]:
            after = r["from_inside"] if state == INSIDE else r["from_outside"]
            rows.append({**{c: r[c] for c in _START.names[:4]}, "first_state": state, "last_state": after})
            state = after
    return pa.Table.from_pylist(rows, to_arrow_schema(_START))


def plan_ranges(spark: SparkSession, path: str, split_bytes: int) -> DataFrame:
    """The ranges of the files at ``path``, with the states at their ends: two jobs that leave a row per range."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path)
    files = files.select("path", F.col("length").alias("size")).where("size > 0")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("at")
    ranges = files.select("path", "size", at, F.lit(split_bytes).cast("long").alias("bytes"))
    tasks = max(1, ranges.count())
    scanned = ranges.repartition(tasks, "path", "at").mapInArrow(_scanned, _RANGE)
    return scanned.groupBy("path").applyInArrow(starts, _START)


# ------------------------------------------------------------------ data source
class _Range(InputPartition):
    def __init__(self, row: dict):
        self.row = row


def records(lines: Iterator[str], taken: list[str]) -> Iterator[tuple[list[str | None], str | None]]:
    """Fields of each record of ``lines``, and its text if a line break of another kind cuts a field; ``taken`` has the lines of the
    record last read."""

    def given():
        for x in lines:
            taken.append(x)
            yield x

    csv.field_size_limit(2**31 - 1)
    reader = csv.reader(given(), quoting=csv.QUOTE_NOTNULL)
    while True:
        taken.clear()
        try:
            fields = next(reader)
        except StopIteration:
            return
        except csv.Error:
            yield [], "".join(taken)
            continue
        if fields:
            yield fields, None


def _parsed(value: str | None, kind: pa.DataType):
    """A text as a value of ``kind``; raises if it isn't one."""
    if value is None or pa.types.is_string(kind):
        return value
    if pa.types.is_floating(kind):
        return float(value)
    return pa.scalar(value).cast(kind).as_py()


def typed(rows: list[list[str | None]], texts: list[str | None], schema: pa.Schema, damaged: str | None) -> pa.RecordBatch:
    """Rows of texts as a batch of ``schema``; ``texts`` are the rows' own, kept where they are damaged."""
    names = [n for n in schema.names if n != damaged]
    bad = [len(r) != len(names) for r in rows]
    columns = {}
    for k, name in enumerate(names):
        kind = schema.field(name).type
        values = [r[k] if k < len(r) else None for r in rows]
        try:
            columns[name] = pc.cast(pa.array(values, pa.string()), kind)
        except pa.ArrowInvalid:
            out = []
            for i, v in enumerate(values):
                try:
                    out.append(_parsed(v, kind))
                except (ValueError, pa.ArrowInvalid):
                    out.append(None)
                    bad[i] = True
            columns[name] = pa.array(out, kind)
    if damaged in schema.names:
        columns[damaged] = pa.array([t if b else None for t, b in zip(texts, bad, strict=True)], pa.string())
    return pa.RecordBatch.from_arrays([columns[n] for n in schema.names], schema=schema)


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.ranges, self.damaged = schema, options["ranges"], options["damaged"]
        self.header, self.folders = options["header"] == "true", [c for c in options["folders"].split(",") if c]

    def partitions(self) -> list[_Range]:
        from pyarrow import fs

        uri = self.ranges
        store, path = (fs.LocalFileSystem(), unquote(urlparse(uri).path)) if urlparse(uri).scheme in ("", "file") else fs.FileSystem.from_uri(uri)
        return [_Range(r) for r in pq.read_table(path, filesystem=store).to_pylist()]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        r = partition.row
        arrow = to_arrow_schema(self.schema)
        fields = pa.schema([f for f in arrow if f.name not in self.folders])
        parts = dict(x.split("=", 1) for x in r["path"].split("/") if "=" in x)
        with _opened(r["path"]) as f:
            lo, hi = first_record(f, r["first"], r["first_state"], r["size"]), first_record(f, r["last"], r["last_state"], r["size"])
            taken: list[str] = []
            found = records(self._lines(f, lo, hi), taken)
            if self.header and lo == 0:
                names, expected = next(found, ([], None))[0], [n for n in fields.names if n != self.damaged]
                if [n and n.lstrip("\ufeff") for n in names] != expected:
                    raise ValueError(f"{r['path']}: the header has {names}, the schema {expected}")
            rows, texts, size = [], [], 0
            for row, _ in found:
                rows.append(row)
                texts.append("".join(taken).removesuffix("\n"))
                size += len(texts[-1])
                if len(rows) >= _ROWS or size >= _BYTES:
                    yield self._batch(rows, texts, fields, arrow, parts)
                    rows, texts, size = [], [], 0
            if rows:
                yield self._batch(rows, texts, fields, arrow, parts)

    def _batch(self, rows, texts, fields: pa.Schema, arrow: pa.Schema, parts: dict[str, str]) -> pa.RecordBatch:
        batch = typed(rows, texts, fields, self.damaged)
        value = lambda c: pa.scalar(unquote(parts[c])).cast(arrow.field(c).type)
        columns = [batch.column(c) if c in fields.names else pa.repeat(value(c), len(rows)) for c in arrow.names]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    @staticmethod
    def _lines(f, lo: int, hi: int) -> Iterator[str]:
        held: list[bytes] = []
        for piece in _pieces(f, lo, hi):
            *whole, rest = piece.split(b"\n")
            for x in whole:
                yield b"".join([*held, x, b"\n"]).decode("utf-8", "replace")
                held = []
            held.append(rest)
        if any(held):
            yield b"".join(held).decode("utf-8", "replace")


class QuotedCsv(DataSource):
    """Options: ``ranges`` (a table of ``plan_ranges``), ``header``, ``damaged`` (column), ``folders`` (columns from folder names)."""

    @classmethod
    def name(cls) -> str:
        return "quoted_csv"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, {"header": "true", "damaged": DAMAGED, "folders": "", **dict(self.options)})


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, split_bytes: int | None = None, header: bool = True,
                    damaged: str | None = DAMAGED, folders: tuple[str, ...] = ()) -> DataFrame:
    """The CSV files at ``path`` with the columns of ``schema`` and ``damaged`` (None: without), by ranges of ``split_bytes`` (by default
    ``spark.sql.files.maxPartitionBytes``). ``folders``: columns of the schema that come from folder names."""
    size = split_bytes or spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    ranges = fresh_path(spark, "csv_ranges")
    plan_ranges(spark, path, size).write.parquet(ranges)
    spark.dataSource.register(QuotedCsv)
    full = T.StructType([*schema.fields, *([T.StructField(damaged, T.StringType())] if damaged else [])])
    options = {"ranges": ranges, "header": str(header).lower(), "damaged": damaged or "", "folders": ",".join(folders)}
    return spark.read.format("quoted_csv").schema(full).options(**options).load()
