"""Legacy ARC archives to WARC, with duplicate payloads as revisits, and WARC archives back to rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Field names of the header lines of ARC versions 1 and 2, as a version block declares them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: An archive that ``pages_to_arc`` builds ends with the record that reaches this size.
ARC_BYTES = 4 << 20
#: A WARC file ends with the record that reaches this size, compressed.
WARC_BYTES = 64 << 20
#: Payloads below this size are never written as revisits.
LEAST_REVISIT_BYTES = 0
#: Digests that repeat, so many at most, are sent to where records are read; more are joined by shuffles.
BROADCAST_DIGESTS = 1_000_000
END = "\r\n\r\n"
#: Bytes of a gzip stream that are unpacked at a time.
PIECE = 1 << 14
#: Behind a record that can't be read, the next line like this begins one.
HEADER_LINE = re.compile(rb"^[a-z][a-z0-9+.-]*:.* \d{12}(\d{2})? .*\d+\r?$", re.IGNORECASE)
#: Archive dates by their length.
DATES = {14: "%Y%m%d%H%M%S", 12: "%Y%m%d%H%M", 8: "%Y%m%d"}


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _arc_line(version: int, url: str, ip: str, date: str, kind: str, length: int) -> bytes:
    values = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Offset": "0"}
    values |= {"Archive-length": str(length)}
    return (" ".join(values.get(name, "-") for name in ARC_FIELDS[version].split()) + "\n").encode()


def _arc_start(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 loamgraph\n{ARC_FIELDS[version]}\n".encode()
    return _arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body)) + body + b"\n"


@dataclass(frozen=True)
class ArcRecord:
    """Fields of a header line and as many bytes as it declares, or why the record can't be read."""

    fields: dict[str, str]
    body: bytes
    error: str | None = None
    version: bool = False  #: the version block that an archive begins with


def _unpacked(content: bytes) -> bytes:
    """The content of all gzip members, as far as they can be read."""
    view, parts, at = memoryview(content), [], 0
    if content[:2] != b"\x1f\x8b":
        return content
    while content[at : at + 2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            while not member.eof and at < len(content):  # a piece at a time, as what is left over is copied
                piece = view[at : at + PIECE]
                parts.append(member.decompress(piece))
                at += len(piece) - len(member.unused_data)
        except zlib.error:
            break
    return b"".join(parts)


def arc_records(content: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC archive, version blocks among them.

    The version block says which fields the header lines have; version 1 and 2 lines are told apart by it alone. Only the
    first record can be one, as pages may be named like it; one whose fields don't begin with a URL and end with a length
    is given with an error, and the fields of its version hold. Fields are read from the right, as URLs may have spaces. A line that can't be read, and a record that ends early, are given
    with an error, and what follows is passed over up to the next header line.
    """
    content = _unpacked(content)
    at, fields, lost, first = 0, None, False, True
    while at < len(content):
        stop = content.find(b"\n", at)
        stop = len(content) if stop < 0 else stop
        raw, at = content[at:stop], stop + 1
        if not raw.rstrip(b"\r") or lost and not HEADER_LINE.match(raw):
            continue
        line = raw.decode("utf-8", "replace").rstrip("\r")
        values, lost = line.split(" "), False
        begins, first = first, False
        if not (values[-1].isascii() and values[-1].isdigit()):
            lost = True
            yield ArcRecord({"URL": values[0]}, b"", f"no length in the header line: {line[:200]}")
            continue
        length = int(values[-1])
        body = content[at : at + length]
        at += length
        if len(body) < length:
            yield ArcRecord({"URL": values[0]}, body, f"record ends before its {length} bytes: {line[:200]}")
        elif begins and values[0].startswith("filedesc://"):
            head = body.decode("utf-8", "replace").splitlines()
            usual = ARC_FIELDS[2 if head and head[0].startswith("2") else 1].split()
            named = head[1].split() if len(head) > 1 and head[1].strip() else usual
            sound = named[0] == "URL" and named[-1].lower().endswith("length") and len(set(named)) == len(named) > 1
            fields, error = (named, None) if sound else (usual, f"fields of the version block: {head[1][:200]}")
            yield ArcRecord({"URL": values[0], "Archive-date": values[2] if len(values) > 2 else ""}, body, error, True)
        elif fields is None or len(values) < len(fields):
            yield ArcRecord({"URL": values[0]}, body, f"header line unlike the version block: {line[:200]}")
        else:
            spare = len(values) - len(fields)
            yield ArcRecord(dict(zip(fields, [" ".join(values[: spare + 1]), *values[spare + 1 :]], strict=True)), body)


ARCHIVES = "path string, content binary"


def pages_to_arc(pages: DataFrame, archive_bytes: int = ARC_BYTES, date: str = "20260101000000") -> DataFrame:
    """ARC archives (path, content) of ``pages`` (page_id, url, html), versions 1 and 2 in turn.

    A null html is an empty payload; a null or blank url becomes ``urn:page``; white space in
    urls is escaped. The page_id travels in a header of the archived HTTP response.
    """

    def built(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, content = TaskContext.get().partitionId(), 0, bytearray()

        def archive() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"path": f"part-{part:06d}-{count:06d}.arc", "content": bytes(content)}])

        for batch in batches:
            for page in batch.to_pylist():
                version = 1 + count % 2
                content = content or bytearray(_arc_start(version, f"part-{part:06d}-{count:06d}.arc", date))
                payload = (page["html"] or "").encode()
                own = "" if page["page_id"] is None else f"X-Page-Id: {page['page_id']}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n"
                body = head.encode() + payload
                url = re.sub(r"\s", "%20", page["url"] or "") or "urn:page"
                content += _arc_line(version, url, "0.0.0.0", date, "text/html", len(body)) + body + b"\n"
                if len(content) >= archive_bytes:
                    yield archive()
                    count, content = count + 1, bytearray()
        if content:
            yield archive()

    return pages.select("page_id", "url", "html").mapInArrow(built, ARCHIVES)


RECORDS = (
    "record_id string, kind string, url string, ip string, warc_date string, content_type string, page_id long, http_head binary,"
    " payload binary, payload_bytes long, payload_digest string, error string"
)
ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _schema(fields: str) -> pa.Schema:
    return pa.schema([(f.split()[0], ARROW[f.split()[1]]) for f in fields.split(",")])


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP response with the blank line that ends it, whatever its newlines, and the payload."""
    gap = re.search(rb"\r?\n\r?\n", block) if block[:5] == b"HTTP/" else None
    return (block[: gap.end()], block[gap.end() :]) if gap else (b"", block)


def _header(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].strip().decode("utf-8", "replace") if found else None


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and re.fullmatch(r"-?[0-9]{1,18}", value) else None


@lru_cache(maxsize=4096)
def _warc_date(value: str) -> str | None:
    """A W3C date of an archive date of 14, 12 or 8 digits, null if it is none."""
    try:
        return datetime.strptime(value, DATES[len(value)]).replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except (KeyError, ValueError):
        return None


def _converted(record: ArcRecord) -> tuple:
    """What WARC needs of a record, in the order of RECORDS."""
    url, kind = record.fields["URL"], record.fields.get("Content-type", "")
    date = _warc_date(record.fields.get("Archive-date", ""))
    if record.error is None and date is None and not record.version:
        record = ArcRecord(record.fields, record.body, f"no date: {record.fields.get('Archive-date')}")
    if record.error is not None:
        own = uuid.uuid5(uuid.NAMESPACE_URL, f"rejected\n{url}\n{record.error}\n{sha1_base32(record.body)}")
        return own.urn, "rejected", url, None, None, None, None, None, record.body, len(record.body), None, record.error
    head, payload = _split_http(record.body)
    digest, ip = sha1_base32(payload), record.fields.get("IP-address")
    if record.version:
        what, kind = "warcinfo", "text/plain"
    else:
        what, kind = ("response", "application/http; msgtype=response") if head else ("resource", kind or "application/octet-stream")
    own = uuid.uuid5(uuid.NAMESPACE_URL, "\n".join([url, ip or "", date or "", head.decode("latin-1"), digest]))
    return own.urn, what, url, ip, date or "1970-01-01T00:00:00Z", kind, _number(_header(head, "X-Page-Id")), head, payload, len(payload), digest, None


def arc_to_records(archives: DataFrame) -> DataFrame:
    """What WARC needs of each record of ARC ``archives`` (path, content, as binaryFile reads them).

    kind is response for HTTP responses, resource for what has no HTTP head (DNS answers, say), warcinfo for version
    blocks, and rejected, with an error, for what can't be read. Identifiers derive from the record's content, so
    converting anew gives the same ones; dates become W3C ones; digests are bare base32 SHA-1 of the payload. HTTP heads
    stay as they are, byte for byte.
    """
    names = [f.split()[0] for f in RECORDS.split(",")]

    def converted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows = [dict(zip(names, _converted(r), strict=True)) for r in arc_records(content.as_py())]
                yield pa.RecordBatch.from_pylist(rows, _schema(RECORDS))

    return archives.select("path", "content").mapInArrow(converted, RECORDS)


def with_record_type(records: DataFrame, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """``records`` with record_type and refers_to, the record_id that a revisit repeats.

    Of responses with equal payloads of ``least_bytes`` or more, the one with the smallest page_id is the response (every
    one of them if the row is repeated, or if no page_id is known). Other kinds stay what they are. Only digests that
    repeat are looked up, and these, if they are few enough, where records are read, so that no payload is shuffled.
    """
    counts = (F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes)
    known = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "record_id"))
    named = cut(records.where(counts).groupBy("payload_digest").agg(F.min(known).alias("first"), F.count("*").alias("_n")).where("_n > 1 and first is not null").drop("_n"))
    few = named.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    repeats = counts & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return (
        records.join(F.broadcast(named) if few else named, "payload_digest", "left")
        .withColumn("record_type", F.when(repeats, "revisit").otherwise(F.col("kind")))
        .withColumn("refers_to", F.when(repeats, F.col("first.record_id")))
        .drop("first")
    )


def _member(head: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record as a gzip member of its own that ends with a zero byte."""
    lines = [f"{name}: {value}\r\n" for name, value in head if value is not None]
    record = f"WARC/1.1\r\n{''.join(lines)}Content-Length: {len(block)}{END}".encode() + block + END.encode()
    packed = gzip.compress(record, 6, mtime=0)
    # the last byte is zero for less than 16 MB; behind larger records there is an empty member
    return packed if packed[-1] == 0 else packed + gzip.compress(b"", mtime=0)


def write_warc(records: DataFrame, folder: str, file_bytes: int = WARC_BYTES) -> None:
    """Write WARC 1.1 archives of records that ``with_record_type`` has typed; rejected ones are passed over.

    Each record is a gzip member, so that readers can seek; a file begins with a warcinfo record and ends with the record
    that reaches ``file_bytes``. Spark's text writer puts a zero byte behind each line: the last one of each member.
    """
    profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    columns = ["record_id", "record_type", "url", "ip", "warc_date", "content_type", "http_head", "payload", "payload_digest", "refers_to"]

    def info(part: int, file: int) -> bytes:
        own = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {folder} {part} {file}")
        head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{own.urn}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")]
        return _member(head, b"software: loamgraph\r\nformat: WARC File Format 1.1\r\n")

    def record(row: dict) -> bytes:
        revisit, response = row["record_type"] == "revisit", row["record_type"] in ("response", "revisit")
        head = [
            ("WARC-Type", row["record_type"]),
            ("WARC-Record-ID", f"<{row['record_id']}>"),
            ("WARC-Date", row["warc_date"]),
            ("WARC-Target-URI", None if row["record_type"] == "warcinfo" else re.sub(r"\s", "%20", row["url"])),
            ("WARC-IP-Address", row["ip"]),
            ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}" if response else None),
            ("WARC-Profile", profile if revisit else None),
            ("WARC-Refers-To", f"<{row['refers_to']}>" if revisit else None),
            ("Content-Type", row["content_type"]),
        ]
        return _member(head, row["http_head"] + (b"" if revisit else row["payload"]))

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, size, nth = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if size >= file_bytes:
                    file, size = file + 1, 0
                for value in ([] if size else [info(part, file)]) + [record(row)]:
                    rows.append({"file": file, "nth": nth, "value": value[:-1]})
                    size, nth = size + len(value), nth + 1
            yield pa.RecordBatch.from_pylist(rows, _schema("file long,nth long,value binary"))

    members = records.where("record_type <> 'rejected'").select(columns).mapInArrow(packed, "file long, nth long, value binary")
    lines = members.sortWithinPartitions("file", "nth").select("file", F.col("value").cast("string").alias("value"))
    lines.write.partitionBy("file").option("lineSep", "\0").text(folder)


def warc_records(content: bytes) -> Iterator[tuple[bytes, bytes, str | None]]:
    """Header and block of each record of a WARC archive, by their declared lengths, and why one can't be read."""
    content, at, gap = _unpacked(content), 0, END.encode()
    while at < len(content):
        stop = content.find(gap, at)
        head = content[at:stop] if stop >= 0 else content[at:]
        length = _number(_header(head, "Content-Length"))
        if stop < 0 or not head.startswith(b"WARC/") or length is None:
            yield head[:200], b"", f"no WARC record: {head[:100]!r}"
            at = content.find(b"WARC/1.", at + 1)
            if at < 0:
                return
            continue
        at = stop + len(gap)
        block = content[at : at + length]
        yield head, block, None if len(block) == length else f"record ends before its {length} bytes"
        at += length + len(gap)


READ = "record_id string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the WARC archives in ``folder``, warcinfo ones left out: record_id, record_type, page_id, url,
    payload_bytes and payload_digest, refers_to (a record_id), payload, and error for what can't be read or has another
    digest than its header says. A revisit has no payload here, so payload and payload_bytes are null; its HTTP head may
    say anything."""
    names = [f.split()[0] for f in READ.split(",")]

    def row(head: bytes, block: bytes, error: str | None) -> tuple:
        kind, own, refers = _header(head, "WARC-Type"), _header(head, "WARC-Record-ID"), _header(head, "WARC-Refers-To")
        http, payload = _split_http(block)
        digest = (_header(head, "WARC-Payload-Digest") or "").removeprefix("sha1:") or sha1_base32(payload)
        if error is None and kind in ("response", "resource") and sha1_base32(payload) != digest:
            error = f"payload unlike its digest {digest}"
        there = kind != "revisit"
        return (
            own and own.strip("<>"), kind, _number(_header(http, "X-Page-Id")), _header(head, "WARC-Target-URI"), len(payload) if there else None,
            digest, refers and refers.strip("<>"), payload if there else None, error,
        )

    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows = [dict(zip(names, row(*r), strict=True)) for r in warc_records(content.as_py())]
                yield pa.RecordBatch.from_pylist([r for r in rows if r["record_type"] != "warcinfo"], _schema(READ))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(parsed, READ)


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Archive ``pages`` as ARC, convert to WARC archives in ``folder``, and read those back.

    Returns page_id, payload_bytes, payload_digest, record_type and refers_to (the response's
    page_id, else null), a row per row of ``pages``. A revisit's size is that of the record it refers to. Null html is an
    empty payload, null ids stay null and never are what a revisit refers to, repeated rows of a response all are
    responses. No pages give no archives and no rows; other columns are ignored.
    """
    write_warc(with_record_type(arc_to_records(pages_to_arc(pages)), least_bytes), folder)
    records = cut(read_warc(pages.sparkSession, folder).where("error is null").drop("payload", "url", "error"))
    heads = (
        records.where("record_type = 'response'")
        .join(records.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
        .select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_page"), F.col("payload_bytes").alias("first_bytes"))
        .distinct()
    )
    return records.join(heads, "refers_to", "left").select(
        "page_id", F.coalesce("payload_bytes", "first_bytes").alias("payload_bytes"), "payload_digest", "record_type", F.col("first_page").alias("refers_to")
    )
