"""Web archives: a converter from legacy ARC files to WARC files, with revisit records for repeated payloads.

ARC version 1 headers have five fields, version 2 headers ten; both versions declare the length of what follows. The
converter reads the version block of each file, follows the declared lengths, and synthesises the WARC counterparts:
record ids from file and offset, dates from the 14 digits, record types, target addresses and payload digests.

Archives are written and read by Spark alone (one file a partition, gzip), so any store that Spark knows will do. Texts
never meet in a shuffle: only digests do, and the decisions about revisits come back to the file that holds the record.

Null and empty payloads are records of length 0. A row without page id is a response and never referred to. Repeated page ids
with equal payloads: the first in (file, offset) order is the response. A null address is written as ``about:blank``.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgertide.llm import common

#: Payloads below this size are never revisits.
LEAST_BYTES = 100
DATE = "20240101000000"

# The record definition lines of the two ARC versions.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


class Capture(NamedTuple):
    """A record of an ARC file."""
    offset: int
    url: str
    ip: str
    date: str
    mime: str
    block: bytes


def arc_header(version: int, url: str, date: str, mime: str, length: int, offset: int = 0, name: str = "-") -> str:
    if version == 1:
        return f"{url} 0.0.0.0 {date} {mime} {length}"
    return f"{url} 0.0.0.0 {date} {mime} 200 - - {offset} {name} {length}"


def version_block(version: int, name: str, date: str = DATE) -> str:
    body = f"{version} 0 ledgertide\n{FIELDS[version]}\n"
    return f"{arc_header(version, 'filedesc://' + name, date, 'text/plain', len(body), 0, name)}\n{body}"


def read_arc(stream: io.BufferedIOBase) -> Iterator[Capture]:
    """Records of one ARC file of either version; lines that are no header are passed over."""
    names: list[str] = []
    offset = 0
    while line := stream.readline():
        start, offset = offset, offset + len(line)
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if not (names and len(parts) == len(names) or not names and parts[0].startswith("filedesc://") and len(parts) in (5, 10)) or not parts[-1].isdigit() or len(parts[2]) != 14:
            continue
        block = stream.read(int(parts[-1]))
        offset += len(block)
        if not names:  # the version block says what the later headers hold
            number, definition = block.split(b"\n")[:2]
            names = FIELDS[2 if number.split(b" ")[0] == b"2" else 1].split(" ") if not definition.strip() else definition.decode().split()
            continue
        fields = dict(zip(names, parts, strict=True))
        yield Capture(start, fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], block)


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """HTTP headers by lower-case name, the head's bytes with its empty line, and the payload."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    found = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return found, head + mark, payload


def record_id(path: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{path}#{offset}')}>"


def warc_record(capture: Capture, identity: str, refers_to: tuple[str, str] | None = None) -> str:
    """A WARC record without the two line ends after it; refers_to: page id and record id of the response with this payload."""
    _, head, payload = split_http(capture.block)
    block = head if refers_to else capture.block
    digits = capture.date
    when = f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {identity}", f"WARC-Date: {when}",
             f"WARC-Target-URI: {capture.url}", f"WARC-IP-Address: {capture.ip}", f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
             f"WARC-Identified-Payload-Type: {capture.mime}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to[1]}", f"WARC-Refers-To-Page: {refers_to[0]}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines) + block.decode("utf-8")


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of one WARC file."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, stream.read(int(fields.get("content-length", 0)))


def _opened(content: bytes) -> io.BufferedIOBase:
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = common.SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``size`` bytes of text."""
    kept: list[tuple] = []
    weight = 0
    for row in rows:
        kept.append(row)
        weight += sum(len(x) for x in row if isinstance(x, str)) + 50
        if weight > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), schema.types, strict=True)], schema=schema)
            kept, weight = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), schema.types, strict=True)], schema=schema)


def write_arcs(pages: DataFrame, folder: str, version: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> None:
    """One ARC file a partition; without a version, partitions take versions 1 and 2 in turn."""
    plain = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = pa.schema([("value", pa.string())])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str]]:
        part = TaskContext.get().partitionId()
        kind = version or part % 2 + 1
        name = f"pages-{part:05d}.arc"
        offset = 0
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not offset:
                    head = version_block(kind, name, date)
                    offset = len(head) + 1
                    yield (head,)
                payload = html or ""
                size = len(payload.encode("utf-8"))
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n" + (f"X-Page-Id: {page}\r\n" if page is not None else "") + "\r\n"
                address = quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")
                length = len(http.encode("utf-8")) + size
                record = f"{arc_header(kind, address, date, 'text/html', length, offset, name)}\n{http}{payload}"
                offset += len(record.encode("utf-8")) + 1
                yield (record,)

    plain.mapInArrow(lambda batches: _batched(lines(common.slices(batches, "html")), schema), "value string").write.option("compression", "gzip").option("lineSep", "\n").text(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path", "content")


def arc_index(arcs: DataFrame) -> DataFrame:
    """Each capture's file, offset, record id, page id, payload size and digest."""
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_id", pa.string()), ("page", pa.string()), ("size", pa.int64()), ("digest", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                name = path.as_py()
                for capture in read_arc(_opened(content.as_py())):
                    fields, _, payload = split_http(capture.block)
                    yield name, capture.offset, record_id(name, capture.offset), fields.get("x-page-id"), len(payload), hashlib.sha256(payload).hexdigest()

    return arcs.mapInArrow(lambda batches: _batched(rows(batches), schema), "path string, offset long, record_id string, page string, size long, digest string")


def revisits(index: DataFrame, id_type: str, least: int = LEAST_BYTES) -> DataFrame:
    """Per file: the offsets of its revisit records, each with page id and record id of the response."""
    rows = index.where(F.col("page").isNotNull() & (F.col("size") >= least)).select("path", "offset", "digest", "record_id", F.col("page").cast(id_type).alias("page"))
    first = rows.groupBy("digest").agg(F.min(F.struct("page", "path", "offset", "record_id")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    later = rows.join(first, "digest").where("path <> first.path or offset <> first.offset")
    return later.groupBy("path").agg(F.collect_list(F.struct("offset", F.col("first.page").cast("string").alias("page"), F.col("first.record_id").alias("record_id"))).alias("seen"))


def convert(arcs: DataFrame, decisions: DataFrame, folder: str) -> None:
    """Write the WARC counterpart of every ARC file."""
    schema = pa.schema([("value", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str]]:
        for batch in batches:
            for path, content, seen in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                name = path.as_py()
                known = {x["offset"]: (x["page"], x["record_id"]) for x in seen.as_py() or ()}
                for capture in read_arc(_opened(content.as_py())):
                    yield (warc_record(capture, record_id(name, capture.offset), known.get(capture.offset)),)

    (arcs.join(decisions, "path", "left").select("path", "content", "seen").mapInArrow(lambda batches: _batched(rows(batches), schema), "value string")
     .write.option("compression", "gzip").option("lineSep", "\r\n\r\n").text(folder))


def warc_records(warcs: DataFrame) -> DataFrame:
    """What WARC files hold, read back: page, payload size and digest, type and the page a revisit refers to.

    A response's size and digest are taken from its payload anew; a revisit has them in its HTTP head and its digest field.
    """
    schema = pa.schema([("page", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("record_id", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for content in batch.column(1):
                for fields, block in read_warc(_opened(content.as_py())):
                    http, _, payload = split_http(block)
                    again = fields.get("warc-type") == "revisit"
                    size = int(http.get("content-length", 0)) if again else len(payload)
                    digest = fields["warc-payload-digest"].removeprefix("sha256:") if again else hashlib.sha256(payload).hexdigest()
                    yield http.get("x-page-id"), fields.get("warc-target-uri"), size, digest, fields.get("warc-type"), fields.get("warc-refers-to-page"), fields.get("warc-record-id")

    return warcs.mapInArrow(lambda batches: _batched(rows(batches), schema), "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, record_id string")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_BYTES, version: int | None = None) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, record_id, url."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    old, new = common.work_folder(spark), common.work_folder(spark)
    write_arcs(pages, old, version, id_col, url_col, html_col)
    index = common.stored(arc_index(files(spark, old)))
    convert(files(spark, old), revisits(index, kind, least), new)
    return warc_records(files(spark, new)).select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "record_id", "url")
