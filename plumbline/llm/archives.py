"""Converter from legacy ARC archives to WARC, with writers and readers of both.

An ARC file starts with a version block that names the fields of its header lines (version 1: five fields, version 2: ten);
a record is one header line, the declared number of bytes and a line break. The converter parses each line by its file's
fields and synthesises the WARC record: an identifier from page and digest, the date in ISO form, the type, and SHA-1
digests of payload and block. Of records with equal payloads of at least `least` bytes the one with the largest page id is a
response and the others are revisits that refer to it; only digests are gathered to decide this.

Files are gzip-compressed, written by Spark's text sink (its line separator ends the records) and read whole as binary
files, one file at a time as a stream; every task of the input makes one file, so a file is as large as an input split.

Defined results: a null page id is kept as null and is never referred to; a null html is an empty payload; a null url becomes
`about:blank`; white space in a url is percent-encoded; repeated rows with the largest page id are all responses; an empty
table gives archives without pages; other columns are not archived."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Field names of the header lines by version, and names that the formats prescribe.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 1000
#: Referred-to payloads that are sent to all tasks; with more of them the records are joined by a shuffle.
BROADCAST_ROWS = 100_000
START = datetime(2024, 1, 1, tzinfo=UTC)
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page-archive")
ONE_VALUE = T.StructType([T.StructField("value", T.BinaryType())])
RECORD = "page_id long, uri string, ip string, date string, http binary, payload binary, n long, digest string"
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _emit(rows: Iterator, schema: pa.Schema, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about `most` bytes from (size, dict) pairs."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n + 100
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _values(rows: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    return _emit(((len(r), {"value": r}) for r in rows), to_arrow_schema(ONE_VALUE))


def _write(df: DataFrame, path: str, end: str) -> None:
    df.select(F.col("value").cast("string")).write.option("compression", "gzip").option("lineSep", end).text(path)


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def _streams(batches) -> Iterator[gzip.GzipFile]:
    for batch in batches:
        for content in batch.column(0):
            yield gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))


# --- ARC ----------------------------------------------------------------------


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 page-archive\n{ARC_FIELDS[version]}\n".encode()
    tail = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {START:%Y%m%d%H%M%S} text/plain{tail} {len(body)}\n".encode() + body


def arc_record(version: int, name: str, page_id: int | None, url: str | None, html: bytes | None) -> bytes:
    payload = html or b""
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    when = START + timedelta(seconds=abs(page_id or 0) % 10**8)
    tail = "" if version == 1 else f" 200 - - 0 {name}"
    return f"{uri} 0.0.0.0 {when:%Y%m%d%H%M%S} text/html{tail} {len(block) + len(payload)}\n".encode() + block + payload


def write_arc(pages: DataFrame, path: str) -> None:
    """Archive page_id, url and html; files alternate between the two versions of the format."""
    slim = pages.select(F.col("page_id").cast("long"), "url", F.col("html").cast("binary"))

    def run(batches):
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc"

        def rows():
            yield version_block(version, name)
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(i) for i in range(3))):
                    yield arc_record(version, name, page_id.as_py(), url.as_py(), html.as_py())

        yield from _values(rows())

    _write(slim.mapInArrow(run, ONE_VALUE), path, "\n")


def read_arc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields of the header line, block) of the records of one ARC file, without its version block."""
    fields: list[str] = []
    while line := stream.readline():
        if line == b"\n":
            continue
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        block = stream.read(int(values[-1]))
        if len(block) != int(values[-1]):
            raise ValueError("an ARC record is shorter than declared")
        if values[0].startswith("filedesc://"):
            fields = block.decode().split("\n")[1].split(" ")
            continue
        if len(values) != len(fields):
            raise ValueError("an ARC header line does not have the fields of its version")
        yield dict(zip(fields, values)), block


def _arc_rows(streams, payloads: bool, packed: bool = True):
    for stream in streams:
        for head, block in read_arc(stream):
            http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
            own = re.search(rb"(?m)^X-Page-Id: (-?\d+)\r?$", http)
            row = {"page_id": int(own[1]) if own else None, "n": len(payload), "digest": hashlib.sha1(payload).hexdigest()}
            if payloads:
                row |= {"uri": head["URL"], "ip": head["IP-address"], "date": head["Archive-date"], "http": http,
                        "payload": zlib.compress(payload, 1) if packed else payload}
            yield len(row.get("payload", b"")), row


def arc_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the ARC files below a path; payloads are zlib-compressed on their way."""
    struct = T.StructType.fromDDL(RECORD if payloads else "page_id long, n long, digest string")
    schema = to_arrow_schema(struct)
    return _contents(spark, path).mapInArrow(lambda batches: _emit(_arc_rows(_streams(batches), payloads), schema), struct)


# --- WARC ---------------------------------------------------------------------


def record_id(page_id: int | None, digest: str, uri: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest}' if page_id is not None else f'{uri} {digest}')}>"


def base32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def iso_date(stamp: str) -> str:
    """The 14 digits of an archive date as WARC writes them."""
    if len(stamp) != 14 or not stamp.isdigit():
        raise ValueError("an archive date does not have 14 digits")
    return f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:]}Z"


def warc_record(row: dict, payload: bytes) -> bytes:
    """The record of a page; a revisit has no payload."""
    refers = row["refers_to"]
    block = (row["http"] + b"\r\n\r\n" if row["http"] else b"") + (b"" if refers is not None else payload)
    kind = "revisit" if refers is not None else "response" if row["http"] else "resource"
    head = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(row["page_id"], row["digest"], row["uri"]),
        "WARC-Date": iso_date(row["date"]), "WARC-Target-URI": row["uri"], "WARC-IP-Address": row["ip"],
        "WARC-Payload-Digest": "sha1:" + base32(row["digest"]),
        "WARC-Block-Digest": "sha1:" + base32(hashlib.sha1(block).hexdigest()),
        "Content-Type": "application/http; msgtype=response" if row["http"] else "application/octet-stream",
    }
    if row["page_id"] is not None:
        head["X-Page-Id"] = str(row["page_id"])
    if refers is not None:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers, row["digest"]),
                 "X-Refers-To-Page-Id": str(refers), "X-Payload-Length": str(row["n"])}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def warcinfo(part: int) -> bytes:
    body = b"software: page-archive\r\nformat: WARC File Format 1.1\r\n"
    return (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, str(part), 'warcinfo')}\r\n"
            f"WARC-Date: {START:%Y-%m-%dT%H:%M:%SZ}\r\nContent-Type: application/warc-fields\r\n"
            f"Content-Length: {len(body)}\r\n\r\n").encode() + body


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST_BYTES) -> None:
    """Write the WARC files for the ARC files below a path.

    Digests are gathered first. While few payloads are repeated, each ARC file becomes a WARC file in one pass; with more
    of them, records and digests are joined by a shuffle."""
    slim = arc_records(spark, arc_path, payloads=False).where(F.col("n") >= least)
    first = slim.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies"))
    first = first.where("copies > 1 and first is not null").select("digest", "first")
    some = first.limit(BROADCAST_ROWS + 1).collect()
    if len(some) <= BROADCAST_ROWS:
        sent = spark.sparkContext.broadcast({r["digest"]: r["first"] for r in some})

        def one_pass(batches):
            known = sent.value

            def rows():
                yield warcinfo(TaskContext.get().partitionId())
                for _, row in _arc_rows(_streams(batches), True, packed=False):
                    refers = known.get(row["digest"]) if row["n"] >= least else None
                    yield warc_record(row | {"refers_to": refers if refers != row["page_id"] else None}, row["payload"])

            yield from _values(rows())

        return _write(_contents(spark, arc_path).mapInArrow(one_pass, ONE_VALUE), warc_path, "\r\n\r\n")
    joined = arc_records(spark, arc_path).join(first, "digest", "left")
    refers = F.when((F.col("n") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    names = [*T.StructType.fromDDL(RECORD).fieldNames(), "refers_to"]

    def run(batches):
        def rows():
            yield warcinfo(TaskContext.get().partitionId())
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: batch.column(c)[i].as_py() for c, n in enumerate(names)}
                    yield warc_record(row, zlib.decompress(row["payload"]))

        yield from _values(rows())

    return _write(joined.withColumn("refers_to", refers).select(*names).mapInArrow(run, ONE_VALUE), warc_path, "\r\n\r\n")


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of the records of one WARC file, by declared lengths."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("no WARC record where one should begin")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip()] = value.strip()
        block = stream.read(int(head["Content-Length"]))
        if len(block) != int(head["Content-Length"]):
            raise ValueError("a WARC record is shorter than declared")
        yield head, block


def warc_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record of the WARC files below a path; digests of blocks and payloads are checked."""
    struct = T.StructType.fromDDL(PAGE)
    schema = to_arrow_schema(struct)

    def rows(batches):
        for stream in _streams(batches):
            for head, block in read_warc(stream):
                if head["WARC-Type"] == "warcinfo":
                    continue
                declared = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                if head["WARC-Block-Digest"] != "sha1:" + base32(hashlib.sha1(block).hexdigest()):
                    raise ValueError("a block does not have its digest")
                payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
                revisit = head["WARC-Type"] == "revisit"
                if not revisit and hashlib.sha1(payload).hexdigest() != declared:
                    raise ValueError("a payload does not have its digest")
                own, other = head.get("X-Page-Id"), head.get("X-Refers-To-Page-Id")
                yield 100, {
                    "page_id": int(own) if own else None, "payload_digest": declared, "record_type": head["WARC-Type"],
                    "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(payload),
                    "refers_to": int(other) if other else None}

    return _contents(spark, path).mapInArrow(lambda batches: _emit(rows(batches), schema), struct)
