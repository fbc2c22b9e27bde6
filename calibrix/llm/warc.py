"""WARC archives: writing pages as records, and a splittable reader.

Writing: each task writes archives of one gzip member per record under names of its own and returns their
paths; only paths that a finished attempt returned are in the manifest, so files of lost attempts are never
read. Of pages with equal payloads (at least ``min_payload`` bytes) that with the largest id is stored as a
response, the others as revisits that refer to it.

Reading: archives are cut into byte ranges of ``split_bytes``, one task each. A task scans its range for the
gzip magic, validates each candidate by decoding the start of the member (a WARC version line and header), and
owns the records whose member starts inside the range; the last may be read beyond it. A member written here
carries its own offset in a gzip extra field: the same bytes inside of a stored payload are at another offset,
and aren't taken for a record. Members of other writers have no such field and are validated by their header
and checksum alone. Archives are opened through ``pyarrow.fs`` by their URI, so any store it knows will do.

Nulls: a null payload is empty, a null URL leaves its header out, a null id is written as ``null`` and read as
null (of equal payloads, it counts as the smallest). Repeated rows: every row with the largest id is a
response. Empty tables give archives without records. Other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrix.llm.common import utf8
from calibrix.sources.files import written

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:x-page:"
# The gzip extra subfield that holds a member's offset.
_OFFSET_FIELD = b"WO"
SPLIT_BYTES, FILE_BYTES, READ_BYTES = 32 << 20, 1 << 30, 1 << 18
MANIFEST = "path string, bytes long, records long"
RECORDS = ("path string, offset long, record_id string, record_type string, target_uri string, refers_to string, "
           "payload_digest string, payload_bytes long, payload binary, intact boolean")


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a Hadoop-style URI, and the path in it."""
    uri = re.sub(r"^file:/+", "file:///", uri)
    return pyarrow.fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, offset: int, level: int = 6) -> bytes:
    """A gzip member of ``data`` that is to stand at ``offset``."""
    extra = _OFFSET_FIELD + struct.pack("<HQ", 8, offset)
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    head = MAGIC + b"\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, block: bytes, date: str, **fields: str | None) -> bytes:
    """A WARC record; ``fields`` are named headers with ``_`` for ``-``, None left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A page's response or revisit record; a revisit keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"{RECORD_ID}{'null' if i is None else i}"
    return record(
        "revisit" if revisit else "response", name(page_id), http if revisit else http + payload, date,
        WARC_Target_URI=quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else None, WARC_Payload_Digest=f"sha1:{digest(payload)}",
        WARC_Profile=REVISIT_PROFILE if revisit else None, WARC_Refers_To=f"<{name(refers_to)}>" if revisit else None,
        Content_Type="application/http; msgtype=response")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               min_payload: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 6, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes every page below ``path`` and returns the manifest (``path, bytes, records``), itself written."""
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                       utf8(F.col(f"`{html_col}`")).alias("payload"))
    src = src.withColumn("sha", F.sha1("payload"))
    # One row for each payload that occurs more than once: its size is known once written, so Spark broadcasts it
    # if it is small and else shuffles, splitting hot payloads.
    same = src.where(F.octet_length("payload") >= min_payload).groupBy("sha").agg(
        F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = src.join(written(same.withColumn("again", F.lit(True)), "warc_equal"), "sha", "left").select(
        "id", "url", "payload", "first", (F.coalesce("again", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = open_store(path)
        fs.create_dir(top, recursive=True)
        out, name, at, n = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": posixpath.join(path, name), "bytes": at, "records": n}],
                                              pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

        for batch in batches:
            for x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, at, n = fs.open_output_stream(posixpath.join(top, name), compression=None), 0, 0
                    info = b"format: WARC File Format 1.1\r\n"
                    at += out.write(member(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", info, date, WARC_Filename=name,
                                                  Content_Type="application/warc-fields"), at, level))
                page_id, url, payload, first, revisit = x
                at += out.write(member(page_record(page_id, url, payload, first, revisit, date), at, level))
                n += 1
                if at >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return written(rows.mapInArrow(run, MANIFEST), "warc_manifest")


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes`` of the archives below ``path`` (names and sizes only; nothing is read)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(path)
    return found.select("path", F.col("length").alias("bytes"))


@dataclass
class _Source:
    """Part of a file, read piecemeal from any offset."""

    file: pa.NativeFile
    size: int

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(min(n, self.size - at)) if at < self.size else b""

    def own_offset(self, at: int) -> bool:
        """False if the member at ``at`` says that it belongs at another offset."""
        head = self.read(at, 12)
        if len(head) < 12 or not head[3] & 4:
            return True
        extra, i = self.read(at + 12, struct.unpack("<H", head[10:12])[0]), 0
        while i + 4 <= len(extra):
            size = struct.unpack("<H", extra[i + 2 : i + 4])[0]
            if extra[i : i + 2] == _OFFSET_FIELD and size == 8:
                return struct.unpack("<Q", extra[i + 4 : i + 12])[0] == at
            i += 4 + size
        return True

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The data of the member at ``at`` and its end; None if there is no member that starts with a WARC header."""
        d, out, pos, checked = zlib.decompressobj(31), [], at, False
        try:
            while not d.eof:
                piece = self.read(pos, READ_BYTES if checked else 4096)
                if not piece:
                    return None
                pos += len(piece)
                out.append(d.decompress(piece))
                if not checked and (d.eof or sum(map(len, out)) >= 5):
                    if not b"".join(out).startswith(b"WARC/"):
                        return None
                    checked = True
        except zlib.error:
            return None
        return b"".join(out), pos - len(d.unused_data)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record in a member's data."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        pairs = (line.split(":", 1) for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
        head = {k.strip().lower(): v.strip() for k, v in pairs}
        size = int(head.get("content-length", -1)) if head.get("content-length", "").isdigit() else -1
        if size < 0 or end + 4 + size > len(data):
            return
        yield head, data[end + 4 : end + 4 + size]
        at = end + 8 + size


def scan_range(source: _Source, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records whose member starts in [start, end)."""
    at = start
    while at < end:
        # A piece reaches two bytes further than candidates are taken from, for a magic on its edge.
        piece = source.read(at, min(READ_BYTES, end - at) + len(MAGIC) - 1)
        if len(piece) < len(MAGIC):
            return
        found = piece.find(MAGIC)
        if found < 0:
            at += len(piece) - len(MAGIC) + 1
            continue
        at += found
        if at >= end:
            return
        got = source.member(at) if source.own_offset(at) else None
        records = list(parse_records(got[0])) if got else []
        if not records:
            at += 1
            continue
        for head, block in records:
            yield at, head, block
        at = got[1]


def _row(path: str, offset: int, head: dict[str, str], block: bytes, with_payload: bool) -> dict:
    """A record as a row of ``RECORDS``."""
    kind, payload = head.get("warc-type"), block
    if head.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    said = head.get("warc-payload-digest", "").rpartition(":")[2] or None
    if kind == "revisit":  # the digest and length of what it refers to
        own, size, payload = said, int(length[1]) if length else None, None
    else:
        own, size = digest(payload), len(payload)
    strip = lambda x: x.strip("<>") if x else None
    return {"path": path, "offset": offset, "record_id": strip(head.get("warc-record-id")), "record_type": kind,
            "target_uri": head.get("warc-target-uri"), "refers_to": strip(head.get("warc-refers-to")), "payload_digest": own,
            "payload_bytes": size, "payload": payload if with_payload else None, "intact": said is None or said == own}


def read_warc(archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """The records (``RECORDS``) of archives given as ``path, bytes``: a manifest, or ``list_archives``. A revisit
    has the digest and length of the payload it refers to and no payload; ``intact`` tells whether a payload has
    the digest that its record states."""
    archives = archives.where("bytes > 0").select("path", "bytes")
    n = archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
                             .alias("start")).repartition(int(n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), *[(c, pa.string()) for c in (
            "record_id", "record_type", "target_uri", "refers_to", "payload_digest")], ("payload_bytes", pa.int64()),
            ("payload", pa.binary()), ("intact", pa.bool_())])
        held, size = [], 0
        for batch in batches:
            for path, total, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, inner = open_store(path)
                with fs.open_input_file(inner) as f:
                    for found in scan_range(_Source(f, total), start, min(total, start + split_bytes)):
                        held.append(_row(path, *found, with_payload))
                        size += len(found[2])
                        if len(held) >= 10_000 or size > 32 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return ranges.mapInArrow(run, RECORDS)


def page_records(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records written by ``write_warc``."""
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(RECORD_ID) + 1}) AS bigint)")
    return records.where(F.col("record_id").startswith(RECORD_ID)).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"),
        "intact")
