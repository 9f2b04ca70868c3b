"""Legacy ARC archives to WARC, with revisit records for repeated payloads.

An ARC file starts with a version block (`filedesc://`) whose second line names the version: records
of version 1 have five header fields, those of version 2 ten, and in both the last is the declared
length of the body. From these the converter makes WARC records: type, identifier, ISO timestamp
and SHA-1 payload digest are synthesised; the same ARC record always gives the same identifier.

Archives are written and read through Spark: records become lines that end in the WARC record
terminator, so that files live wherever Spark's paths do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphspan.operators.skew import split_hot
from graphspan.session import materialise, scratch

#: fixed values of the formats
ARC_FIELDS = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
WARC_VERSION = b"WARC/1.1"
END = b"\r\n\r\n"

RECORDS = "key long, type string, record_id string, uri string, date string, mime string, head binary, payload binary, payload_bytes long, digest string"
_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
_ARROW = pa.schema(
    [("key", pa.int64()), *((x, pa.string()) for x in ("type", "record_id", "uri", "date", "mime")), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string())]
)


def digest(payload: bytes) -> str:
    """Base32 of the SHA-1, upper-case, bare."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_block(version: bytes, origin: bytes = b"graphspan", date: bytes = b"20000101000000") -> bytes:
    """The version block that opens an ARC file."""
    body = version + b" 0 " + origin + b"\n" + ARC_FIELDS[version] + b"\n"
    tail = b" 200 - - 0 -" if version == b"2" else b""
    return b"filedesc://" + origin + b".arc 0.0.0.0 " + date + b" text/plain" + tail + b" %d\n" % len(body) + body + b"\n"


def arc_record(version: bytes, url: bytes, date: bytes, mime: bytes, body: bytes, ip: bytes = b"0.0.0.0") -> bytes:
    """One ARC record; white space in the URL is escaped, since it separates the header's fields."""
    url = re.sub(rb"\s", lambda m: b"%%%02X" % m[0][0], url) or b"-"
    tail = b" 200 " + digest(body).encode() + b" - 0 -" if version == b"2" else b""
    return url + b" " + ip + b" " + date + b" " + mime + tail + b" %d\n" % len(body) + body + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[bytes, bytes, bytes, bytes]]:
    """(url, date, mime, body) of each record; raises ValueError where lengths or versions don't hold."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        stop = data.index(b"\n", at)
        line = data[at:stop]
        size = int(line.rsplit(b" ", 1)[1])
        body = data[stop + 1 : stop + 1 + size]
        if len(body) < size:
            raise ValueError("a record ends before its declared length")
        at = stop + 1 + size
        if line.startswith(b"filedesc://"):
            version = body.split(b" ", 1)[0]
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version!r}")
            fields = len(ARC_FIELDS[version].split())
            continue
        if fields is None:
            raise ValueError("records before a version block")
        parts = line.rsplit(b" ", fields - 1)
        if len(parts) != fields:
            raise ValueError("a header line has too few fields")
        yield parts[0], parts[2], parts[3], body


def _converted(url: bytes, date: bytes, mime: bytes, body: bytes) -> dict:
    head, payload = (body.split(END, 1) + [b""])[:2] if body.startswith(b"HTTP/") else (b"", body)
    when = date.ljust(14, b"0").decode()
    key = re.search(rb"\r\nX-Key: (-?\d+)", head)
    sha = digest(payload)
    uri = url.decode("utf-8", "replace")
    return {
        "key": int(key[1]) if key else None,
        "type": "response" if head else "resource",
        "record_id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((uri, when, sha, key[1].decode() if key else '')))}>",
        "uri": uri,
        "date": f"{when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:14]}Z",
        "mime": mime.decode("utf-8", "replace"),
        "head": head,
        "payload": payload,
        "payload_bytes": len(payload),
        "digest": sha,
    }


def arc_to_records(arcs: DataFrame, content_col: str = "content") -> DataFrame:
    """The converted records of ARC files given as bytes, one file a row; a null file has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for record in parse_arc(content.as_py() or b""):
                    rows.append(_converted(*record))
                    size += rows[-1]["payload_bytes"]
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return arcs.select(content_col).mapInArrow(run, RECORDS)


def _digests(records: DataFrame) -> DataFrame:
    return materialise(records.select("key", "digest", "payload_bytes", "record_id"), "digests")


def _marked(records: DataFrame, light: DataFrame, min_bytes: int) -> DataFrame:
    able = light.filter((F.col("payload_bytes") >= min_bytes) & F.col("key").isNotNull())
    first = able.groupBy("digest").agg(F.min(F.struct("key", "record_id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = materialise(first.select("digest", F.col("first.key").alias("refers_key"), F.col("first.record_id").alias("refers_id"), "n"), "first")
    both = [x.select("key", "digest", "refers_key", "refers_id") for x in split_hot(able, first, "digest", "n", light.count())]
    repeats = both[0].union(both[1]).filter("key <> refers_key").groupBy("key", "digest").agg(F.first("refers_key").alias("refers_key"), F.first("refers_id").alias("refers_id"))
    return records.join(materialise(repeats, "repeats"), ["key", "digest"], "left")


def with_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """records with refers_key and refers_id where a record repeats the payload of one with a smaller key.

    Of equal payloads of at least min_bytes the record with the smallest key stays a response and
    the others become revisits of it. Only keys and digests are grouped; a digest that very many
    records share is looked up in a small broadcast table. The repeats are written before they meet
    the payloads, so that their size is known: few are broadcast and no payload moves. Keys should be
    unique: of rows that share the smallest key of a payload each is a response, and a repeat refers
    to that key. A null payload is an empty one.
    """
    return _marked(records, _digests(records), min_bytes)


def convert_archives(arcs: DataFrame, path: str, content_col: str = "content", min_bytes: int = 0, file_bytes: int = 32 << 20) -> None:
    """ARC files, one a row, to WARC files of about file_bytes each, before compression, under path."""
    records = arc_to_records(arcs, content_col)
    write_warc(with_revisits(records, min_bytes), path, file_bytes)


def _warc_bytes(row: dict) -> bytes:
    again = row["refers_key"] is not None
    block = row["head"] + END if row["head"] else b""
    if not again:
        block += row["payload"]
    lines = [
        WARC_VERSION,
        b"WARC-Type: " + (b"revisit" if again else row["type"].encode()),
        b"WARC-Record-ID: " + row["record_id"].encode(),
        b"WARC-Target-URI: " + row["uri"].encode(),
        b"WARC-Date: " + row["date"].encode(),
        b"WARC-Payload-Digest: sha1:" + row["digest"].encode(),
        b"Content-Type: " + (b"application/http; msgtype=response" if row["head"] else row["mime"].encode()),
        b"X-Payload-Length: %d" % row["payload_bytes"],
    ]
    if row["key"] is not None:
        lines.append(b"X-Key: %d" % row["key"])
    if again:
        lines += [
            b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            b"WARC-Refers-To: " + row["refers_id"].encode(),
            b"X-Refers-Key: %d" % row["refers_key"],
        ]
    return b"\r\n".join(lines) + b"\r\nContent-Length: %d" % len(block) + END + block


def write_warc(records: DataFrame, path: str, file_bytes: int = 32 << 20) -> None:
    """Write records (with_revisits) as gzipped WARC files.

    A file is closed once its records add up to file_bytes: it is longer by less than one record.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for lo in range(0, len(batch), 200):
                for row in batch.slice(lo, 200).to_pylist():
                    waiting.append(_warc_bytes(row))
                    size += len(waiting[-1]) + len(END)
                    if size >= file_bytes:
                        yield _file(waiting)
                        waiting, size = [], 0
        if waiting:
            yield _file(waiting)

    def _file(own: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([END.join(own)], pa.binary())], names=["file"])

    files = records.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record."""
    at = 0
    while at < len(data):
        stop = data.index(END, at)
        first, *lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("no WARC record where one should begin")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) < size:
            raise ValueError("a record ends before its declared length")
        at = stop + 8 + size
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """key, type, uri, date, payload (null in revisits), payload_bytes, digest, refers_key of each record.

    A response's length and digest are those of the payload read; a mismatch with its header raises.
    """
    shape = pa.schema([("key", pa.int64()), *((x, pa.string()) for x in ("type", "uri", "date")), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("refers_key", pa.int64())])

    def row(fields: dict[str, str], block: bytes) -> dict:
        again = fields["warc-type"] == "revisit"
        payload = block.split(END, 1)[1] if "msgtype=response" in fields.get("content-type", "") else block
        told = fields["warc-payload-digest"].removeprefix("sha1:")
        if not again and digest(payload) != told:
            raise ValueError("a payload differs from its digest")
        number = lambda k: int(fields[k]) if k in fields else None
        return {
            "key": number("x-key"), "type": fields["warc-type"], "uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"),
            "payload": None if again else payload, "payload_bytes": number("x-payload-length") if again else len(payload), "digest": told, "refers_key": number("x-refers-key"),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                raw = gzip.GzipFile(fileobj=io.BytesIO(raw)).read() if raw[:2] == b"\x1f\x8b" else raw  # all members
                rows: list[dict] = []
                for fields, block in parse_warc(raw):
                    rows.append(row(fields, block))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=shape)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "key long, type string, uri string, date string, payload binary, payload_bytes long, digest string, refers_key long")


def pages_to_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records: int = 250, file_bytes: int = 8 << 20) -> DataFrame:
    """(content): pages as ARC files, versions 1 and 2 by turns.

    A file has up to `records` records, and is closed once they add up to file_bytes.
    Null URLs are written as `-`, null bodies as empty ones; a null id leaves the key header out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            for lo in range(0, len(batch), records):
                version, parts, size = b"", [], 0
                for key, url, html in zip(*(batch.slice(lo, records).columns), strict=True):
                    if not parts:
                        turn += 1
                        version = b"1" if turn % 2 else b"2"
                        parts.append(arc_block(version))
                    payload, key = (html.as_py() or "").encode(), key.as_py()
                    own = b"\r\nX-Key: %d" % key if key is not None else b""
                    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + own + END + payload
                    parts.append(arc_record(version, (url.as_py() or "").encode(), b"20000101000000", b"text/html", body))
                    size += len(parts[-1])
                    if size >= file_bytes:
                        yield packed(parts)
                        parts, size = [], 0
                if parts:
                    yield packed(parts)

    def packed(parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

    return pages.select(F.col(id_col).cast("long"), url_col, html_col).mapInArrow(run, "content binary")


def op7(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch(spark, "warc")
    convert_archives(pages_to_arcs(pages), path)
    return read_warc(spark, path).select(
        F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_key").alias("refers_to"),
    )
