"""Legacy web archives: ARC files are read by their version's header lines and declared lengths, and rewritten as WARC.

``write_arc`` lays pages out as ARC files, ``read_arc`` parses any ARC file of version 1 or 2, and
``convert`` synthesises equivalent WARC records: identifiers from the record's place, timestamps from the
14-digit date, the record type from scheme and content, block and payload digests.  Records with
equal payloads become revisits of the one with the largest page_id.  ``read_warc`` reads archives back.

Files are written by Spark's own writer (one archive a row, one row a file, WARC files packed with gzip as
a whole), so a lost task leaves no half-written archive.  An archive holds about ``ARCHIVE_BYTES``, one long page more at most.

Edge cases: null html is an empty payload; a null or unusable url becomes ``urn:page:<page_id>``; of
repeated rows with the largest page_id the first in its archive is the response; rows with a null
page_id are responses only where their payload has no row with an identifier, and then refer to
nothing; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.llm.common import broadcast_if, new_area, path_exists, table, write_table

ARCHIVE_BYTES = 4_000_000
#: The field names of the two versions' header lines.
FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE_HEADER = "X-Page-Id"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def clean_url(url: str | None, page_id: int | None) -> str:
    """The url with everything quoted that would break a header line."""
    return quote(url.strip(), safe="!#$%&'()*+,/:;=?@[]~") if url and url.strip() else f"urn:page:{'' if page_id is None else page_id}"


# ---- ARC ---------------------------------------------------------------------------------------


def arc_header(version: str, url: str, ip: str, date: str, mime: str, length: int, *, code: str = "-", name: str = "-", offset: int = 0) -> str:
    if version == "1":
        return f"{url} {ip} {date} {mime} {length}\n"
    return f"{url} {ip} {date} {mime} {code} - - {offset} {name} {length}\n"


def arc_start(version: str, name: str, date: str) -> str:
    body = f"{version} 0 latticework\n{FIELDS[version]}\n\n"
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), code="200", name=name) + body + "\n"


def write_arc(pages: DataFrame, path: str, *, date: str = "20240101000000", compression: str = "uncompressed") -> None:
    """ARC files below ``path`` from page_id, url and html; versions alternate from archive to archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n, parts, size = TaskContext.get().partitionId(), 0, [], 0

        def start() -> None:
            nonlocal size
            text = arc_start("12"[(task + n) % 2], f"pages-{task:05d}-{n:05d}.arc", date)
            parts[:] = [text]
            size = len(text)

        for batch in batches:
            for page, url, html in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if not parts:
                    start()
                body = html or ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{_PAGE_HEADER}: {'' if page is None else page}\r\nContent-Length: {len(body.encode())}\r\n\r\n"
                length = len(head) + len(body.encode())
                version = "12"[(task + n) % 2]
                line = arc_header(version, clean_url(url, page), "0.0.0.0", date, "text/html", length, code="200", name=f"pages-{task:05d}-{n:05d}.arc", offset=size)
                parts += [line, head, body, "\n"]
                size += len(line) + length + 1
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(["".join(parts)], pa.string())], names=["value"])
                    parts.clear()
                    n += 1
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(["".join(parts)], pa.string())], names=["value"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    source.mapInArrow(run, "value string").write.option("maxRecordsPerFile", 1).option("compression", compression).text(path)


def parse_arc(raw: bytes) -> Iterator[dict]:
    """The records of one ARC file after its version block, with the fields of the block's own header line.

    Raises ValueError where a header line or a declared length doesn't fit the file.
    """
    at, fields, version = 0, None, None
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no header line at byte {at}")
        values = raw[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if not values[-1].isdigit():
            raise ValueError(f"no declared length at byte {at}: {values[-1][:40]!r}")
        length, body = int(values[-1]), end + 1
        if body + length > len(raw):
            raise ValueError(f"record at byte {at} declares {length} bytes; {len(raw) - body} are left")
        content = raw[body : body + length]
        if fields is None:
            if not values[0].startswith("filedesc://"):
                raise ValueError("no version block at the start")
            lines = content.decode("utf-8", "replace").split("\n")
            version = lines[0].split(" ")[0]
            fields = lines[1].strip().split(" ") if len(lines) > 1 and lines[1].strip() else FIELDS.get(version, "").split(" ")
            if version not in FIELDS:
                raise ValueError(f"version {version!r} isn't known")
            yield {"version": version, "offset": at, "URL": values[0], "filedesc": True, "content": content, "Archive-date": values[2]}
        else:
            extra = len(values) - len(fields)
            if extra < 0:
                raise ValueError(f"{len(values)} fields at byte {at}; version {version} has {len(fields)}")
            values = [" ".join(values[: extra + 1]), *values[extra + 1 :]]  # a url with spaces takes the extra parts
            yield {"version": version, "offset": at, "filedesc": False, "content": content} | dict(zip(fields, values, strict=True))
        at = body + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(header with its empty line, payload) of an HTTP message; no header where there is none."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def http_field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return m[1].decode("utf-8", "replace").strip() if m else None


RECORD = "record_id string, page_id long, url string, date string, warc_type string, content_type string, head binary, payload binary, payload_bytes long, sha1 string, sha256 binary, archive string, offset long"


def synthesise(record: dict, archive: str) -> tuple:
    """What a WARC record needs, from one ARC record: identifier, timestamp, type and digests."""
    head, payload = split_http(record["content"])
    url = record["URL"]
    try:
        date = datetime.strptime(record["Archive-date"][:14].ljust(14, "0"), "%Y%m%d%H%M%S").replace(tzinfo=UTC)
    except ValueError:
        date = datetime(1970, 1, 1, tzinfo=UTC)
    kind = "response" if head else "resource"
    page = http_field(head, _PAGE_HEADER)
    place = uuid.uuid5(uuid.NAMESPACE_URL, f"{archive}#{record['offset']}")
    return (
        f"<urn:uuid:{place}>", int(page) if page and re.fullmatch(r"-?\d+", page) else None, url, date.strftime("%Y-%m-%dT%H:%M:%SZ"), kind,
        "application/http; msgtype=response" if head else record.get("Content-type", "application/octet-stream"), head, payload, len(payload),
        base32_sha1(payload), hashlib.sha256(payload).digest(), archive, record["offset"],
    )


_RECORD_KINDS = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64())
_RECORD_NAMES = [x.split(" ")[0] for x in RECORD.split(", ")]


def unpacked(raw: bytes) -> bytes:
    """An archive's bytes; gzip files, of one or many members, are unpacked."""
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def _files(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all ARC files below ``path`` (version blocks left out), ready to be written as WARC."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [synthesise(r, name) for r in parse_arc(unpacked(raw.as_py())) if not r["filedesc"]]
                columns = zip(*rows, strict=True) if rows else [[]] * len(_RECORD_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _RECORD_KINDS, strict=True)], names=_RECORD_NAMES)

    return _files(spark, path).mapInArrow(run, RECORD)


# ---- WARC --------------------------------------------------------------------------------------


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def convert(spark: SparkSession, source: str, target: str, *, least_bytes: int = 0, compression: str = "gzip") -> None:
    """ARC files below ``source`` -> WARC files below ``target``; equal payloads of ``least_bytes`` or more are stored once."""
    records = read_arc(spark, source)
    area = new_area(spark, "warc")
    small = write_table(records.select("record_id", "page_id", "url", "date", "payload_bytes", "sha1", "sha256", "archive", "offset"), f"{area}/digests")
    # Of equal payloads (equal SHA-1, SHA-256 and length) the record with the largest page_id is stored; the first in its archive breaks ties.
    order = F.struct(F.col("page_id").isNull().alias("none"), (-F.col("page_id")).alias("less"), "archive", "offset", "record_id", "url", "date")
    stored = small.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1", "sha256", "payload_bytes").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stored = write_table(stored.select("sha1", "sha256", "payload_bytes", "first"), f"{area}/stored")
    # Which record refers to which is found on narrow rows; payloads move by their own record only, so a common payload is no hot key.
    referring = small.join(broadcast_if(stored, stored.count(), 200_000), ["sha1", "sha256", "payload_bytes"]).where(F.col("first.record_id") != F.col("record_id"))
    referring = referring.select("record_id", F.col("first.record_id").alias("refers_to"), F.col("first.url").alias("refers_url"), F.col("first.date").alias("refers_date"))
    referring = write_table(referring, f"{area}/referring")
    joined = records.join(broadcast_if(referring, referring.count(), 200_000), "record_id", "left")
    joined = joined.select("record_id", "url", "date", "warc_type", "content_type", "head", "payload", "sha1", "refers_to", "refers_url", "refers_date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not parts:
                    info = b"software: latticework\r\nformat: WARC File Format 1.1\r\n"
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"info {row[0]}")
                    parts.append(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", row[2]), ("Content-Type", "application/warc-fields")], info))
                parts.append(_as_warc(*row))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["value"])

    joined.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", compression).text(target)


def _as_warc(record_id: str, url: str, date: str, kind: str, content_type: str, head: bytes, payload: bytes, sha1: str, refers_to: str | None, refers_url: str | None, refers_date: str | None) -> bytes:
    block = head if refers_to else head + payload
    fields = [("WARC-Type", "revisit" if refers_to else kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", url)]
    if refers_to:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", refers_to), ("WARC-Refers-To-Target-URI", refers_url or ""), ("WARC-Refers-To-Date", refers_date or "")]
    fields += [("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", content_type)]
    return warc_record(fields, block)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record, by declared lengths."""
    at = 0
    while at < len(raw):
        if raw[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = raw.find(b"\r\n\r\n", at)
        if not raw.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:])
        length, body = int(fields["Content-Length"]), end + 4
        if body + length > len(raw):
            raise ValueError(f"record at byte {at} declares {length} bytes; {len(raw) - body} are left")
        yield fields, raw[body : body + length]
        at = body + length


READ = "record_id string, warc_type string, url string, date string, page_id long, payload binary, payload_bytes long, payload_digest string, refers_record string"
_READ_KINDS = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string())
_READ_NAMES = [x.split(" ")[0] for x in READ.split(", ")]


def _read_back(fields: dict[str, str], block: bytes) -> tuple:
    head, payload = split_http(block)
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    size: int | None = len(payload)
    if fields["WARC-Type"] == "revisit":  # the payload is the referred record's; its length stands in the HTTP header kept here
        size = int(http_field(head, "Content-Length") or 0)
    elif digest != (own := base32_sha1(payload)):
        raise ValueError(f"payload digest of {fields['WARC-Record-ID']} is {own}, not {digest}")
    page = http_field(head, _PAGE_HEADER)
    return (fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Target-URI"), fields.get("WARC-Date"), int(page) if page else None, payload, size, digest, fields.get("WARC-Refers-To"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files below ``path`` but their warcinfo; digests of stored payloads are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(1):
                rows = [_read_back(f, b) for f, b in parse_warc(unpacked(raw.as_py())) if f["WARC-Type"] != "warcinfo"]
                columns = zip(*rows, strict=True) if rows else [[]] * len(_READ_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _READ_KINDS, strict=True)], names=_READ_NAMES)

    return _files(spark, path).mapInArrow(run, READ)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = new_area(spark, "archives")
    write_arc(table(spark, sf_dir, "pages"), f"{area}/arc")
    convert(spark, f"{area}/arc", f"{area}/warc")
    back = write_table(read_warc(spark, f"{area}/warc").drop("payload"), f"{area}/back")
    target = back.select(F.col("record_id").alias("target"), F.col("page_id").alias("target_page"))
    # Only records that are referred to meet the revisits.
    wanted = back.where("refers_record IS NOT NULL").select(F.col("refers_record").alias("target")).distinct()
    target = target.join(wanted, "target", "left_semi")
    n = target.count()
    joined = back.join(broadcast_if(target, n), F.col("refers_record") == F.col("target"), "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", F.when(F.col("warc_type") == "revisit", "revisit").otherwise("response").alias("record_type"), F.col("target_page").alias("refers_to"))


QUERIES = {"op4_warc": op4_warc}
ORACLE_SQL = {
    "op4_warc": r"""
WITH d AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, strlen(payload) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((('0x' || substr(hex, 1 + (5 * i) // 4, 2))::INTEGER) >> (3 - (5 * i) % 4)::INTEGER) & 31), 1)), '') AS payload_digest FROM d),
g AS (SELECT payload_digest, max(page_id) AS stored FROM b GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = stored THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> stored THEN stored END AS refers_to
FROM b JOIN g USING (payload_digest)
"""
}
