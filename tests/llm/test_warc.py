"""WARC packages: round trips, revisits, and directories against what wrote them."""

import base64
import gzip
import hashlib
import io
import json
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.llm import warc
from cadenza.session import shared_dir

SCHEMA = "page_id long, url string, html string, place string, first string, payload string, offset long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1) for r in rows], SCHEMA)


ODD = [
    (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, "<p>one</p>"), (4, "http://a/4", None), (5, "u", ""),
    (6, "http://a/6\r\nX: y", "é日本😀\r\n\r\nWARC/1.1\r\n"), (None, "n", "alone"), (None, "n", "two"), (7, "n", "two"), (8, "r", "again"), (8, "r", "again"), (8, "r", "again"),
    (9, "long", "<p>" + "x y z " * 300_000), (10, "%0A %25", "percent"),
]


def wanted(rows):
    by = {}
    for page_id, _, html in rows:
        by.setdefault(html or "", []).append(page_id)
    out = []
    for html, ids in by.items():
        data = html.encode()
        top, *rest = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out += [(top, len(data), digest, "response", None)] + [(i, len(data), digest, "revisit", top) for i in rest]
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("records", [2, 20_000])
def test_round_trip_equals_brute_force(spark, monkeypatch, records):
    rng = random.Random(1)
    rows = ODD + [(20 + i, f"h{i}", f"<b>{rng.randint(0, 15)}</b>") for i in range(200)]
    monkeypatch.setattr(warc, "RECORDS", records)
    found = [tuple(r) for r in warc.round_trip(pages(spark, rows)).collect()]
    assert sorted(found, key=key) == sorted(wanted(rows), key=key)


def test_small_payloads_never_revisit(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    found = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, rows), least_bytes=3).collect()}
    assert found == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_no_pages(spark):
    assert warc.round_trip(pages(spark, ODD).limit(0)).count() == 0


def test_payloads_and_packages_are_whole(spark):
    folder = f"{shared_dir(spark)}/warc-test"
    packages = warc.write(pages(spark, ODD), folder)
    rows = warc.read(packages, payloads=True).collect()
    texts = {r.payload.decode() for r in rows if r.record_type == "response"}
    assert texts == {html or "" for _, _, html in ODD}
    assert {r.url for r in rows if r.page_id == 6} == {"http://a/6%0D%0AX: y"} and {r.url for r in rows if r.page_id == 3} == {None}
    for path in (r.path for r in packages.collect()):  # other readers agree
        with zipfile.ZipFile(path.removeprefix("file://")) as z:
            assert z.testzip() is None
            every = gzip.decompress(z.read(warc.ARCHIVE))
            lines = [json.loads(x[x.index("{") :]) for x in z.read(warc.INDEX).decode().split("\n") if x]
            assert every.count(b"WARC/1.1\r\nWARC-Type") == len(lines) == packages.filter(F.col("path") == path).first().records


def file_of(data):
    return pa.BufferReader(data)


def zipped(n=3, comment=b"", **kw):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", **kw) as z:
        for i in range(n):
            z.writestr(f"archive/é{i}.warc.gz", b"data %d" % i)
        z.comment = comment
    return out.getvalue()


def same_as_zipfile(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        f = file_of(data)
        members = list(warc.directory(f))
        assert [(m.name, m.method, m.size) for m in members] == [(i.filename, i.compress_type, i.compress_size) for i in infos]
        for m, i in zip(members, infos, strict=True):
            assert f.read_at(m.size, warc.data_at(f, m)) == z.read(i.filename)


def test_directories(monkeypatch):
    same_as_zipfile(zipped())
    same_as_zipfile(zipped(0))
    same_as_zipfile(zipped(5, b"a comment"))
    assert len(list(warc.directory(file_of(zipped(5, b"PK\x05\x06 in a comment"))))) == 5
    same_as_zipfile(b"#!/bin/sh some bytes before\n" + zipped())
    same_as_zipfile(zipped(30_000))  # the directory is read in pieces
    same_as_zipfile(zipped(70_000))  # more members than 16 bits count
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 4)
    same_as_zipfile(zipped(50))
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    same_as_zipfile(b"before" + zipped(50))


def test_places_beyond_32_bits(tmp_path):
    path = tmp_path / "far.wacz"
    with path.open("w+b") as f:
        f.seek(5 << 30)  # a hole
        with zipfile.ZipFile(f, "w") as z:
            data = warc.gzipped(warc.record(1, "u", b"far", None, 0)[0])
            z.writestr("archive/x.warc.gz", data)
            z.writestr("indexes/x.cdx", "u 1 " + json.dumps({"filename": "x.warc.gz", "offset": "0", "length": str(len(data))}))
    store, name = warc.opened(str(path))
    with store.open_input_file(name) as f:
        ((at, n),) = warc.ranges(f)
        assert at > 5 << 30 and warc.parsed(gzip.decompress(f.read_at(n, at)))["payload"] == b"far"


def test_what_cannot_be_read_is_an_error():
    for data in (b"", b"no zip at all", zipped()[:-30], zipped()[: len(zipped()) // 2]):
        with pytest.raises(ValueError):
            list(warc.directory(file_of(data)))
    squeezed = zipped(1, compression=zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="compressed"):
        warc.data_at(file_of(squeezed), next(iter(warc.directory(file_of(squeezed)))))
    data, _ = warc.record(1, "u", b"payload", None, 0)
    with pytest.raises(ValueError, match="not the one"):
        warc.parsed(data.replace(b"payload\r\n", b"paiload\r\n"))


def test_neighbours_are_read_together():
    rows = [("a", 0, 5), ("a", 5, 5), ("a", 20, warc.SPAN + 1), ("a", 21 + warc.SPAN, 1), ("b", 22 + warc.SPAN, 1)]
    assert [(p, at, len(x)) for p, at, x in warc._together(rows)] == [("a", 0, 2), ("a", 20, 1), ("a", 21 + warc.SPAN, 1), ("b", 22 + warc.SPAN, 1)]
