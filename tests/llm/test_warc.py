import base64
import gzip
import hashlib
import io
import random
import uuid
from urllib.parse import quote

import pytest

from calibrix.config import scratch_path
from calibrix.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, sha string, first long"


def archive(spark, pages, split_bytes=700, **options):
    path = scratch_path(spark, "warc", uuid.uuid4().hex)
    manifest = warc.write_warc(pages, path, **options)
    return path, manifest, warc.read_warc(manifest, split_bytes)


def expected(pages, min_payload=0):
    largest = {}
    for i, _, html in pages:
        key = html or ""
        if key not in largest or (i is not None and (largest[key] is None or i > largest[key])):
            largest[key] = i
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        first = largest[html or ""]
        response = i == first or len(data) < min_payload
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit",
                    None if response else first))
    return sorted(out, key=str)


PAGES = [(i, f"http://e.org/{i} ä", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)] + [
    (100, None, None), (101, "", ""), (None, "http://n", "same"), (102, "http://n\r\nX: y", "same"), (102, "http://n", "same"),
    (-3, "u", "é" * 50_000), (103, "u", "é" * 50_000)]


@pytest.mark.parametrize("min_payload", [0, 10])
def test_round_trip(spark, min_payload):
    pages = spark.createDataFrame([(*p, "x", "y", 1) for p in PAGES], SCHEMA)
    path, manifest, records = archive(spark, pages, min_payload=min_payload, file_bytes=4000)
    rows = warc.page_records(records)
    got = sorted([tuple(r)[:5] for r in rows.collect()], key=str)
    assert got == expected(PAGES, min_payload)
    assert rows.where("not intact").count() == 0
    assert warc.list_archives(spark, path).count() == manifest.count() > 3
    payloads = {r.record_id: bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect()}
    assert payloads["urn:x-page:103"] == "é" * 50_000


def test_every_split_size_gives_each_record_once(spark):
    pages = spark.createDataFrame([(*p, None, None, None) for p in PAGES[:20]], SCHEMA)
    _, manifest, _ = archive(spark, pages)
    for split in (97, 500, 1 << 20):
        assert warc.read_warc(manifest, split).count() == 20 + manifest.count()  # and one warcinfo each


def test_no_pages(spark):
    _, _, records = archive(spark, spark.createDataFrame([], SCHEMA))
    assert warc.page_records(records).count() == 0


class Held(warc._Source):
    def __init__(self, data):
        super().__init__(io.BytesIO(data), len(data))


def test_members_inside_a_payload_are_no_records():
    inner = warc.member(warc.page_record(1, "u", b"inner", None, False, "d"), 0)
    inner += warc.member(warc.page_record(2, "u", b"inner", None, False, "d"), len(inner))
    data = b""
    for block in (b"first", inner, b"last"):  # stored without compression: the inner members stand in the file as they are
        data += warc.member(warc.page_record(9, "u", block, None, False, "d"), len(data), level=0)
    assert data.count(warc.MAGIC) == 5
    for split in (1, 50, 10_000):
        found = [x for lo in range(0, len(data), split) for x in warc.scan_range(Held(data), lo, min(len(data), lo + split))]
        assert [h["warc-record-id"] for _, h, _ in found] == ["<urn:x-page:9>"] * 3


def test_archives_of_other_writers_and_noise():
    rnd = random.Random(5)
    data, offsets = b"", []
    for i in range(30):
        offsets.append(len(data))
        data += gzip.compress(warc.record("resource", f"urn:x:{i}", bytes(rnd.choices(b"\x1f\x8b\x08ab", k=rnd.randrange(3000))), "d"))
    for split in (64, 1000, len(data)):
        found = [o for lo in range(0, len(data), split) for o, _, _ in warc.scan_range(Held(data), lo, min(len(data), lo + split))]
        assert found == offsets
    broken = data[: offsets[3] + 20] + data[offsets[4] :]  # a member cut short: the others are still found
    found = [h["warc-record-id"] for _, h, _ in warc.scan_range(Held(broken), 0, len(broken))]
    assert found == [f"<urn:x:{i}>" for i in range(30) if i != 3]


def test_urls_of_any_length(spark, tmp_path):
    urls = ["http://a/", "data:text/html," + "x" * 70_000, "http://a/" + "漢" * 30_000, "data:," + "y" * 3_000_000, None]
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    manifest = warc.write_warc(pages, (tmp_path / "long").as_uri())
    for split in (1 << 20, 4096):
        rows = warc.read_warc(manifest, split_bytes=split).where("record_type != 'warcinfo'").collect()
        assert len(rows) == manifest.agg({"records": "sum"}).first()[0] == len(urls)
        assert sorted((r.target_uri or "")[:40] + str(len(r.target_uri or "")) for r in rows) == sorted(
            (quote(u, safe=":/,") if u else "")[:40] + str(len(quote(u, safe=":/,")) if u else 0) for u in urls)
