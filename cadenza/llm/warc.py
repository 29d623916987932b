"""Web pages as WARC records in ZIP packages, and a reader that takes records out of them by range.

A package is a ZIP file whose members are stored as they are: ``archive/data.warc.gz`` (one
gzip member per record), ``indexes/index.cdxj`` (a line per record: key, date, and place in
the archive) and ``datapackage.json``.

Method: the reader opens a package at its end, finds the end-of-directory record (and, where
counts or offsets do not fit, the ZIP64 one), parses the central directory, locates the stored
archive members and indexes by their local headers, and reads each record by the range
that the index gives.  Nothing is extracted: neighbouring ranges are read together, up to
``SPAN`` bytes at a time, whatever the size of the package.

Plan: writing scans the pages twice, once for digests and once for the packages.  Which of
equal payloads is the response is decided on slim rows (digest, id, place): a maximum with partial
sums, joined back on salted digests; pages meet the decision by the place where they lie, so
that a payload that a third of all pages share is spread like any other.  A task writes packages of at
most ``PACKAGE`` bytes or ``RECORDS`` records; names are unique per attempt and only those that an attempt
returned are read, so a lost or repeated task leaves no wrong record behind.  Reading spreads
(path, place) rows over all tasks by range.

Of records with equal payloads (of at least ``least_bytes`` bytes) the one with the largest
page_id is the response and the others revisit it.  Edge cases: null html is an empty
payload; null ids come last in that order and are null again when read; a null url has no target
header and is null when read; line breaks in urls are escaped; of equal rows one is the
response and the others revisit their own id; an empty table gives no package and no rows;
extra columns are ignored, whatever their names.  ``pages`` is read twice and its rows are told
apart by their place, so it must be a stored table or otherwise the same in the same order each time.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialise, shared_dir

PACKAGE = 64 << 20
RECORDS = 20_000
SPAN = 8 << 20
SALTS = 32
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture
SPACE = uuid.UUID("8d6c3f0e-4b0a-5c55-9d5e-0f6f1a2b3c4d")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
READ = "path string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# ---- packages: writing


def record_id(page_id: int | None, digest: str, place: int | None = None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}' + ('' if place is None else f':{place}'))}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: dict | None, place: int) -> tuple[bytes, str]:
    """A WARC record and its payload's digest; ``first``: page_id and url of the response that it revisits."""
    digest = base32(hashlib.sha1(payload).digest())
    head = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page_id, digest, place if first else None)), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", url), ("WARC-Page-ID", page_id), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first["page_id"], digest)), ("WARC-Refers-To-Target-URI", first["url"]), ("WARC-Refers-To-Page-ID", first["page_id"])]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = [f"{k}: {_escaped(str(v))}" for k, v in head if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n\r\n", digest


def _escaped(value: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", value)


def gzipped(data: bytes) -> bytes:
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


class Package:
    """One package on its way out; records go straight to the store, the index is kept until the end."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        store, name = opened(self.path)
        self.stream = store.open_output_stream(name)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, data: bytes, **found: object) -> None:
        squeezed = gzipped(data)
        self.member.write(squeezed)
        place = {"filename": ARCHIVE.rpartition("/")[2], "offset": self.size, "length": len(squeezed)}
        self.index.append(json.dumps(found | place, ensure_ascii=False))
        self.size += len(squeezed)

    @property
    def full(self) -> bool:
        return self.size >= PACKAGE or len(self.index) >= RECORDS

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        date = re.sub(r"[^0-9]", "", DATE)
        lines = [f"{quote(json.loads(x)['url'] or '-', safe=':/?#[]@!$&()*+,;=%')} {date} {x}\n" for x in self.index]
        self.zip.writestr(INDEX, "".join(lines))
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": ARCHIVE, "bytes": self.size}, {"path": INDEX}]}))
        self.zip.close()
        self.stream.close()
        return self.path, self.size, len(self.index)


def _placed(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("place", F.monotonically_increasing_id())


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """place, first (page_id and url of the response) of every row that is not the response of its payload."""
    slim = _placed(pages).select("place", "page_id", "url", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("size"))
    slim = materialise(slim.filter(F.col("size") >= least_bytes).drop("size"), "warc-digests")
    best = slim.groupBy("sha1").agg(F.max(F.struct("page_id", "place", "url")).alias("best"), F.count("*").alias("rows")).filter("rows > 1")
    best = best.select("sha1", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = slim.withColumn("salt", (F.col("place") % SALTS).cast("int")).join(best, ["sha1", "salt"]).filter(F.col("place") != F.col("best.place"))
    return met.select("place", F.struct("best.page_id", "best.url").alias("first"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """path, bytes and records of the packages written to ``folder``."""
    known = materialise(revisits(pages, least_bytes), "warc-revisits")  # its size on disk decides between broadcast and shuffle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None

        def closed() -> pa.RecordBatch:
            path, size, n = package.close()
            return pa.record_batch({"path": [path], "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

        for batch in batches:
            for page_id, url, payload, place, first in zip(*(batch[c] for c in ("page_id", "url", "payload", "place", "first")), strict=True):
                package = package or Package(folder)
                page_id, url = page_id.as_py(), url.as_py()
                data, digest = record(page_id, url, payload.as_py(), first.as_py(), place.as_py())
                package.add(data, url=url, page_id=page_id, digest=f"sha1:{digest}")
                if package.full:
                    yield closed()
                    package = None
        if package:
            yield closed()

    store, name = opened(folder)
    store.create_dir(name, recursive=True)
    rows = _placed(pages).join(known, "place", "left")
    return materialise(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-packages")


# ---- packages: reading


class Member(NamedTuple):
    name: str
    method: int
    at: int  # of its local header
    size: int  # as it lies in the file


def _range(f: pa.NativeFile, at: int, n: int) -> bytes:
    found = f.read_at(n, at)
    if len(found) != n:
        raise ValueError(f"the file ends within a range of {n} bytes at {at}")
    return found


def directory(f: pa.NativeFile) -> Iterator[Member]:
    """The members of a ZIP file by its central directory, which is read in pieces."""
    total = f.size()
    tail_at = max(0, total - 65_557)  # a comment has at most 65,535 bytes
    tail = _range(f, tail_at, total - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    n, size, start = struct.unpack_from("<H2L", tail, at + 10)
    end = tail_at + at
    if end >= 20 and (locator := _range(f, end - 20, 20))[:4] == b"PK\x06\x07":
        (where,) = struct.unpack_from("<Q", locator, 8)
        places = [x for x in (where, end - 76) if 0 <= x <= end - 76]  # as the locator says, or right before it where bytes were put in front
        where = next((x for x in places if _range(f, x, 4) == b"PK\x06\x06"), -1)
        if where < 0:
            raise ValueError("the ZIP64 locator points elsewhere")
        record64 = _range(f, where, 56)
        n, size, start = struct.unpack_from("<3Q", record64, 32)
        end = where
    elif 0xFFFF == n or 0xFFFFFFFF in (size, start):
        raise ValueError("no ZIP64 directory where one is needed")
    shift = end - size - start  # bytes put before the archive
    at, buffer, taken = start + shift, b"", 0
    for _ in range(n):
        if len(buffer) - taken < 46 or len(buffer) - taken < _entry(buffer, taken):
            more = buffer[taken:]
            left = end - at - len(more)
            buffer, taken = more + _range(f, at + len(more), min(left, 1 << 20)), 0
        length = _entry(buffer, taken)
        yield _member(buffer[taken : taken + length], shift)
        at += length
        taken += length


def _entry(buffer: bytes, at: int) -> int:
    if buffer[at : at + 4] != b"PK\x01\x02":
        raise ValueError("no entry of a central directory")
    return 46 + sum(struct.unpack_from("<3H", buffer, at + 28))


def _member(entry: bytes, shift: int) -> Member:
    flags, method = struct.unpack_from("<2H", entry, 8)
    squeezed, size, n_name, n_extra = struct.unpack_from("<2L2H", entry, 20)
    (at,) = struct.unpack_from("<L", entry, 42)
    name, extra = entry[46 : 46 + n_name], entry[46 + n_name : 46 + n_name + n_extra]
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<2H", extra)
        if kind == 1:  # 64-bit values of the fields that say so, in this order
            wide = iter(struct.unpack_from(f"<{min(n, 24) // 8}Q", extra, 4))
            size = next(wide) if size == 0xFFFFFFFF else size
            squeezed = next(wide) if squeezed == 0xFFFFFFFF else squeezed
            at = next(wide) if at == 0xFFFFFFFF else at
        extra = extra[4 + n :]
    return Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, at + shift, squeezed)


def data_at(f: pa.NativeFile, member: Member) -> int:
    """Where a stored member's own bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; ranges can be read of stored members only")
    head = _range(f, member.at, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{member.name} has no local header")
    return member.at + 30 + sum(struct.unpack_from("<2H", head, 26))


def _lines(f: pa.NativeFile, at: int, size: int) -> Iterator[bytes]:
    rest, end = b"", at + size
    while at < end:
        piece = _range(f, at, min(SPAN, end - at))
        at += len(piece)
        *whole, rest = (rest + piece).split(b"\n")
        yield from whole
    if rest:
        yield rest


def ranges(f: pa.NativeFile) -> Iterator[tuple[int, int]]:
    """Place and length in the package of every record that its indexes name."""
    members = list(directory(f))
    starts = {m.name.rpartition("/")[2]: data_at(f, m) for m in members if m.name.startswith("archive/") and not m.name.endswith("/")}
    for m in members:
        if m.name.startswith("indexes/") and m.name.endswith((".cdx", ".cdxj")):
            for line in _lines(f, data_at(f, m), m.size):
                if b"{" in line:
                    found = json.loads(line[line.index(b"{") :])
                    yield starts[found["filename"]] + int(found["offset"]), int(found["length"])


def records(packages: DataFrame) -> DataFrame:
    """path, offset and length of every record of the packages (path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(path: str, found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch({"path": [path] * len(found), "offset": pa.array([x for x, _ in found], pa.int64()), "length": pa.array([x for _, x in found], pa.int64())})

        for batch in batches:
            for path in batch["path"].to_pylist():
                store, name = opened(path)
                with store.open_input_file(name) as f:
                    part = []
                    for found in ranges(f):
                        part.append(found)
                        if len(part) == 10_000:
                            yield rows(path, part)
                            part = []
                    if part:
                        yield rows(path, part)

    return packages.select("path").mapInArrow(run, "path string, offset long, length long")


def parsed(data: bytes) -> dict:
    """What a record's bytes say; its payload is held against the digest that it claims."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\ncontent-length: *(\d+)", http)[1])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = named["WARC-Type"]
    if kind == "response" and (len(payload) != length or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"the payload of {named['WARC-Record-ID']} is not the one that was written")
    number = lambda k: int(named[k]) if k in named else None
    return {"page_id": number("WARC-Page-ID"), "url": named.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("WARC-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


def _together(rows: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Ranges that lie side by side, up to ``SPAN`` bytes: path, place, (place, length) of each."""
    now: tuple[str, int, list[tuple[int, int]]] | None = None
    end = 0
    for path, at, n in rows:
        if now and (path, at) == (now[0], end) and end + n - now[1] <= SPAN:
            now[2].append((at, n))
        else:
            if now:
                yield now
            now = (path, at, [(at, n)])
        end = at + n
    if now:
        yield now


def read(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the packages (path), one row each, with the payload of responses if asked for."""
    spark = packages.sparkSession
    schema = READ + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, f = None, None
        for batch in batches:
            rows = zip(batch["path"].to_pylist(), batch["offset"].to_pylist(), batch["length"].to_pylist(), strict=True)
            for path, at, parts in _together(rows):
                if path != last:
                    if f:
                        f.close()
                    store, name = opened(path)
                    last, f = path, store.open_input_file(name)
                data = memoryview(_range(f, at, parts[-1][0] + parts[-1][1] - at))
                out = [parsed(zlib.decompress(data[start - at : start - at + n], 31)) | {"path": path, "offset": start} for start, n in parts]
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in names} for row in out], schema=arrow)
        if f:
            f.close()

    spread = records(packages).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "offset").sortWithinPartitions("path", "offset")
    return spread.mapInArrow(run, schema)


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, as read back from its package."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder, least_bytes)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
