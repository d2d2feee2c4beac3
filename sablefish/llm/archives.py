"""Operator 2, WARC: a converter of legacy ARC archives.

An ARC volume starts with a ``filedesc`` record whose body names the version; the version
fixes the fields of all later header lines (five in version 1, ten in version 2), and the
last field declares the length of the body. Records are cut by these lengths alone, so bodies
may hold anything. Each record becomes an equivalent WARC record: the identifier is a
name-based UUID of volume and offset, the date comes from the 14-digit archive date, the type
from the URL scheme and body (``filedesc`` becomes ``warcinfo``, an HTTP message ``response``,
anything else ``resource``), digests are SHA-1 of payload and block. Of responses with equal
payloads of at least ``LEAST_REVISIT`` bytes, the one with the largest page id stays a response
and the others become ``revisit`` records, which hold the HTTP header only.

Volumes are made on the executors, a gzip member a record and of bounded size, and written
and read by Spark (text sink with a NUL line separator, which gzip readers take as padding;
``binaryFile`` source), so any shared store works.

Defined results: a null html is an empty payload; a null page id stays null and counts as the
smallest; of rows equal in page id and payload, the one latest in the archives is the response;
an empty table gives no volumes and an empty result; a record is never split, so a
volume is at most ``VOLUME_BYTES`` plus one record. Columns other than page id, url and html
aren't read. White space and control characters in URLs are percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_path, staged

VOLUME_BYTES = 4 << 20
LEAST_REVISIT = 1000
#: Revisits up to this number are looked up by broadcast, more by a shuffled join.
BROADCAST_REVISITS = 100_000
# Fixed values of the ARC format: header fields by version.
FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
SPELLING = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:sablefish:arc")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


class ArchiveError(ValueError):
    """An archive whose header lines or declared lengths can't be followed."""


def gzip_member(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def members(data: bytes, chunk: int = 8192) -> bytes:
    """All gzip members of ``data`` (zero padding between and after them is skipped), or plain data as it is.

    Input goes in by chunks, so that what follows a member is copied a chunk at a time only.
    """
    if data[:2] != b"\x1f\x8b":
        return data.rstrip(b"\0") if data[-1:] == b"\0" else data
    out, at, view = [], 0, memoryview(data)
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if at >= len(data):
                raise ArchiveError("the last gzip member is cut off")
            part = view[at : at + chunk]
            out.append(unpack.decompress(part))
            at += len(part) - len(unpack.unused_data)
    return b"".join(out)


# ARC


class ArcRecord(NamedTuple):
    volume: str
    offset: int
    fields: dict[str, str]
    body: bytes


def arc_start(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 sablefish\n".encode() + SPELLING[version] + b"\n\n"
    head = ["filedesc://" + name, "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else []) + [str(len(body))]
    return " ".join(head).encode() + b"\n" + body


def arc_record(url: str, date: str, kind: str, body: bytes, version: int, ip: str = "0.0.0.0", code: int = 200, name: str = "-", offset: int = 0) -> bytes:
    url = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) or "-"
    head = [url, ip, date, kind]
    if version == 2:
        head += [str(code), hashlib.sha1(body).hexdigest(), "-", str(offset), name]
    return " ".join([*head, str(len(body))]).encode("utf-8", "surrogatepass") + b"\n" + body + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC volume, its ``filedesc`` record first."""
    data = members(data)
    at, version, volume = 0, 1, ""
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError(f"no end of the header line at {at}")
        words = data[at:end].decode("utf-8", "surrogatepass").rstrip("\r").split(" ")
        first = words[0].startswith("filedesc:")
        if first and len(words) not in map(len, FIELDS.values()):
            raise ArchiveError(f"{len(words)} fields in the filedesc line at {at}")
        names = FIELDS[version] if not first else next(f for f in FIELDS.values() if len(f) == len(words))
        if len(words) != len(names) or not words[-1].isdigit():
            raise ArchiveError(f"a version {version} header line has {len(names)} fields and a length; at {at} there is {words!r}")
        start, stop = end + 1, end + 1 + int(words[-1])
        if stop > len(data):
            raise ArchiveError(f"the body at {start} is declared to end at {stop}, after the end of the data")
        body = data[start:stop]
        if first:
            version = int(body.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ArchiveError(f"unknown version {version}")
            volume = words[0].removeprefix("filedesc://")
        yield ArcRecord(volume, at, dict(zip(names, words, strict=True)), body)
        at = stop


# WARC


class WarcRecord(NamedTuple):
    headers: dict[str, str]
    block: bytes


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def payload_of(block: bytes) -> tuple[bytes, bytes]:
    """The header (with its empty line) and the entity of an HTTP message."""
    head, gap, entity = block.partition(b"\r\n\r\n")
    return head + gap, entity


def record_id(volume: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{volume}@{offset}')}>"


def iso_date(digits: str) -> str:
    """A 14-digit archive date (or a shorter one, whose missing parts are the smallest) as a WARC date."""
    full = digits + "00000101000000"[len(digits) :] if len(digits) < 14 else digits[:14]
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError as e:
        raise ArchiveError(f"the archive date {digits!r} can't be read") from e


def convert(arc: ArcRecord, refers_to: tuple[str, str] | None = None) -> WarcRecord:
    """The equivalent WARC record; ``refers_to`` (identifier, page) makes a response a revisit."""
    f, block = arc.fields, arc.body
    headers = {"WARC-Type": "resource", "WARC-Record-ID": record_id(arc.volume, arc.offset), "WARC-Date": iso_date(f["date"])}
    if f["url"].startswith("filedesc:"):
        headers |= {"WARC-Type": "warcinfo", "WARC-Filename": arc.volume, "Content-Type": "application/warc-fields"}
        block = b"software: sablefish\r\nformat: WARC File Format 1.1\r\nconverted-from: ARC version " + block.split(b" ", 1)[0] + CRLF
    else:
        headers |= {"WARC-Target-URI": f["url"], "WARC-IP-Address": f["ip"], "Content-Type": f["type"]}
        if block.startswith(b"HTTP/"):
            head, entity = payload_of(block)
            headers |= {"WARC-Type": "response", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": sha1_32(entity)}
            if refers_to is not None:
                headers |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to[0], "X-Refers-To-Page": refers_to[1]}
                block = head
        else:
            headers["WARC-Payload-Digest"] = sha1_32(block)
    return WarcRecord(headers | {"WARC-Block-Digest": sha1_32(block)}, block)


def write_warc(record: WarcRecord) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*record.headers.items(), ("Content-Length", len(record.block))])
    return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + CRLF + record.block + CRLF + CRLF


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    data = members(data)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ArchiveError(f"no record at {at}")
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        stop = start + int(headers.pop("Content-Length"))
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ArchiveError(f"the block at {start} doesn't end at {stop}")
        yield WarcRecord(headers, data[start:stop])
        at = stop + 4


# Spark


def volumes(records: Iterable[bytes], start: bytes) -> Iterator[bytes]:
    """Records (compressed) gathered to volumes that each begin with ``start``."""
    held, size = [start], len(start)
    for r in records:
        if size + len(r) > VOLUME_BYTES and len(held) > 1:
            yield b"".join(held)
            held, size = [start], len(start)
        held.append(r)
        size += len(r)
    if len(held) > 1:
        yield b"".join(held)


def save(df: DataFrame, path: str) -> None:
    """Writes the binary column ``volume`` as files, one a row."""
    df.select(F.col("volume").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("content")


def http_response(payload: bytes, page: str) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {page}\r\n\r\n".encode() + payload


def http_field(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode() if m and m[1] else None


def write_arc(df: DataFrame, path: str, date: str = "20200101000000") -> None:
    """ARC volumes of pages (page_id, url, html); odd partitions use version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version, number = 1 + task % 2, 0
        held: list[bytes] = []
        plain = size = 0

        def name() -> str:
            return f"pages-{task:06d}-{number:05d}.arc.gz"

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["volume"])

        for batch in batches:
            for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if not held:
                    start = arc_start(name(), version, date)
                    held, plain = [gzip_member(start)], len(start)
                    size = len(held[0])
                body = http_response((html or "").encode("utf-8", "surrogatepass"), "" if page is None else str(page))
                record = arc_record(url or "-", date, "text/html", body, version, name=name(), offset=plain)
                plain += len(record)
                held.append(gzip_member(record))
                size += len(held[-1])
                if size >= VOLUME_BYTES:
                    yield whole()
                    held, number = [], number + 1
        if held:
            yield whole()

    narrow = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    save(narrow.transform(arrow_map, run, "volume binary"), path)


def index_arc(arcs: DataFrame) -> DataFrame:
    """record, page_id, payload digest and length of each HTTP record of ARC volumes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for arc in read_arc(content.as_py()):
                    if arc.body.startswith(b"HTTP/") and not arc.fields["url"].startswith("filedesc:"):
                        head, entity = payload_of(arc.body)
                        page = http_field(head, b"X-Page-Id")
                        rows.append((record_id(arc.volume, arc.offset), int(page) if page else None, hashlib.sha1(entity).hexdigest(), len(entity)))
                columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["record", "page_id", "digest", "size"])

    return arcs.transform(arrow_map, run, "record string, page_id long, digest string, size long")


def revisits(spark: SparkSession, index: DataFrame) -> DataFrame:
    """record, refers_to and refers_page of each record that repeats another's payload."""
    long = index.where(F.col("size") >= LEAST_REVISIT)
    last = long.groupBy("digest").agg(F.max(F.struct("page_id", "record")).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    last = staged(spark, last.select("digest", "last"), "payloads")
    return (
        long.join(last, "digest")
        .where(F.col("record") != F.col("last.record"))
        .select("record", F.col("last.record").alias("refers_to"), F.col("last.page_id").alias("refers_page"))
    )


def convert_volumes(spark: SparkSession, arcs: DataFrame, repeats: DataFrame, path: str) -> None:
    """WARC volumes with a record for each record of the ARC volumes."""

    names = ["record", "volume", "at", "url", "ip", "date", "type", "body"]

    def as_batch(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * 4, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held: list[tuple] = []
                size = 0
                for arc in read_arc(content.as_py()):
                    f = arc.fields
                    if f["url"].startswith("filedesc:"):
                        continue
                    held.append((record_id(arc.volume, arc.offset), arc.volume, arc.offset, f["url"], f["ip"], f["date"], f["type"], arc.body))
                    size += len(arc.body)
                    if size > VOLUME_BYTES:
                        yield as_batch(held)
                        held, size = [], 0
                if held:
                    yield as_batch(held)

    rows = arcs.transform(arrow_map, parse, "record string, volume string, at long, url string, ip string, date string, type string, body binary")
    few = repeats.limit(BROADCAST_REVISITS + 1).count() <= BROADCAST_REVISITS
    joined = rows.join(F.broadcast(repeats) if few else repeats, "record", "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        info = convert(ArcRecord(f"pages-{task:06d}.warc.gz", 0, {"url": "filedesc://", "date": "20200101000000"}, b"1 "))

        def records() -> Iterator[bytes]:
            for batch in batches:
                for r in batch.to_pylist():
                    to = None if r["refers_to"] is None else (r["refers_to"], "" if r["refers_page"] is None else str(r["refers_page"]))
                    yield gzip_member(write_warc(convert(ArcRecord(r["volume"], r["at"], r, r["body"]), to)))

        for v in volumes(records(), gzip_member(write_warc(info))):
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary())], names=["volume"])

    save(joined.transform(arrow_map, pack, "volume binary"), path)


def read_back(warcs: DataFrame) -> DataFrame:
    """What the WARC volumes say of each page."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "record_id", "warc_date"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for r in read_warc(content.as_py()):
                    kind = r.headers["WARC-Type"]
                    if kind not in ("response", "revisit"):
                        continue
                    head, entity = payload_of(r.block)
                    digest = base64.b32decode(r.headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    if kind == "response" and hashlib.sha1(entity).hexdigest() != digest:
                        raise ArchiveError(f"the payload of {r.headers['WARC-Record-ID']} doesn't have its digest")
                    size = len(entity) if kind == "response" else int(http_field(head, b"Content-Length") or 0)
                    page, to = http_field(head, b"X-Page-Id"), r.headers.get("X-Refers-To-Page")
                    rows.append((int(page) if page else None, size, digest, kind, int(to) if to else None, r.headers["WARC-Target-URI"], r.headers["WARC-Record-ID"], r.headers["WARC-Date"]))
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return warcs.transform(arrow_map, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, warc_date string")


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages through ARC volumes into WARC volumes, and these read back: a row a page."""
    arc_path, warc_path = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_arc(pages, arc_path)
    arcs = load(spark, arc_path)
    index = staged(spark, index_arc(arcs), "arc-index")
    repeats = staged(spark, revisits(spark, index), "revisits")
    convert_volumes(spark, arcs, repeats, warc_path)
    return read_back(load(spark, warc_path))
