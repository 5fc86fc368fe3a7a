"""Web archives: a converter from the legacy ARC format, WARC files, and revisits by payload.

ARC records begin with one line whose fields depend on the file's version; the last is the
declared length, by which, and never by looking for separators, content is taken. From each
record the converter makes the WARC record: an identifier from what the record holds, the date
from its 14 digits, the type from the content, and the digests. Content is bytes of any kind.

Pages go through it: they are written as ARC records, converted and stored as WARC files, each
record a gzip member of its own, so that readers can seek to it. Spark's text writer makes the
files: committed as one job, on any file system, with no local files on executors. It writes rows of
raw bytes and ends each with one byte; that is the last byte of the row's last member, which
is always 0 (see members_ending_in_zero), so the files hold members and nothing else. A file has at most
CHUNKS rows of about CHUNK bytes. They are read back by the declared lengths.

Defined results: null html is an empty payload; a null url is an empty target; a page without id
is always a response; rows that repeat an id and a payload all are what the first is; payloads
are equal when their SHA-256 and lengths are; a revisit names its original's record, address and date; rows that are equal in
all fields are one record, written for each; pages have no time, so all get the given date; an
empty table gives an empty archive; other columns, whatever their names, are not looked at. Lines
that aren't record lines are passed over; a record that the file ends in is kept and marked
as truncated.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.exact_dedup import tree_merge
from docweave.llm.storage import fresh_path, materialise, materialise_counted, skew_join

#: Fixed field names of the two versions' record lines, as files declare them.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("8d3c7b52-6a0e-5c1f-9f0b-2d6b8f1f4c11")
PAGE, REFERS = "X-Page-Id", "X-Refers-To-Page-Id"
EOL = "\r\n"
END = EOL * 2
#: Compressed bytes of a row, and rows of a file: files are read in one piece, so their size is bounded.
CHUNK, CHUNKS = 16 << 20, 8
#: Bytes and records after which an ARC file is converted and the next one begins.
ARC_BYTES, ARC_RECORDS = 4 << 20, 256
_EMPTY = gzip.compress(b"", mtime=0)
_KEPT = "".join(map(chr, range(33, 127)))


def sha1_base32(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes
    cut: bool = False


def arc_header(version: int, name: str, date: str) -> bytes:
    """The record that opens an ARC file and declares its version."""
    body = f"{version} 0 docweave\n{' '.join(ARC_FIELDS[version])}\n".encode()
    rest = f"{len(body)}" if version == 1 else f"200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {rest}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, date: str, block: bytes, offset: int = 0, name: str = "-", ip: str = "0.0.0.0", kind: str = "text/html") -> bytes:
    rest = f"{len(block)}" if version == 1 else f"200 {sha1_base32(block)} - {offset} {name} {len(block)}"
    return f"{quote(url, safe=':/?#[]@!$&()*+,;=%~-._') or '-'} {ip} {date} {kind} {rest}\n".encode() + block + b"\n"


def record_line(line: bytes, version: int) -> tuple[dict[str, str], int] | None:
    """The fields of a record line and the declared length; None if it isn't one. A URL's spaces and bytes outside ASCII are escaped."""
    words = line.rstrip(b"\r\n").split(b" ")
    names = ARC_FIELDS[1 if line.startswith(b"filedesc://") and len(words) < len(ARC_FIELDS[2]) else version]
    extra = len(words) - len(names)
    if extra < 0 or not words[-1].isdigit():
        return None
    words = [b"%20".join(words[: extra + 1]), *words[extra + 1 :]]
    return dict(zip(names, (quote(w, safe=_KEPT) for w in words), strict=True)), int(words[-1])


def parse_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """The records of an ARC file, its opening one first. Other lines are passed over; the last record may be cut short."""
    version = 1
    while line := stream.readline():
        found = record_line(line, version)
        if found is None:
            continue
        fields, length = found
        block = stream.read(length)
        if fields["URL"].startswith("filedesc://"):
            head = block.split(None, 1)
            version = int(head[0]) if head and head[0].isdigit() and int(head[0]) in ARC_FIELDS else 1
        yield ArcRecord(version, fields, block, len(block) < length)


def split_http(block: bytes) -> tuple[dict[str, str], bytes] | None:
    """HTTP header fields and payload, or None if the block isn't an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None
    for mark in (b"\r\n\r\n", b"\n\n"):
        head, found, payload = block.partition(mark)
        if found:
            lines = head.decode("utf-8", "replace").splitlines()
            return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}, payload
    return {}, b""


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""

    def raw(self) -> bytes:
        """The record with the two line ends after it."""
        head = EOL.join([WARC_VERSION, *(f"{k}: {v}" for k, v in self.headers.items()), f"Content-Length: {len(self.block)}"])
        return (head + END).encode() + self.block + END.encode()

    def header(self, name: str) -> str | None:
        """A header's value; names are the same in any case."""
        return next((v for k, v in self.headers.items() if k.lower() == name.lower()), None)


def members_ending_in_zero(records: list[bytes]) -> bytes:
    """A gzip member for each record. A member ends with its content's length, so one that doesn't end in 0 (over 16 MB) gets an empty member after it."""
    out = b"".join(gzip.compress(r, 6, mtime=0) for r in records)
    return out if out.endswith(b"\0") else out + _EMPTY


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(parts))}>"


def iso_date(digits: str) -> str:
    d = (digits + "00000101000000"[len(digits) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(record: ArcRecord, original: tuple[str, str, bytes] | None = None) -> WarcRecord:
    """The equivalent WARC record; with original, the id, address and block of the page whose payload it repeats, a revisit of that page's record."""
    url, date = record.fields["URL"], iso_date(record.fields["Archive-date"])
    headers = {"WARC-Type": "", "WARC-Record-ID": "", "WARC-Date": date}
    if record.cut:
        headers["WARC-Truncated"] = "length"
    if url.startswith("filedesc://"):
        headers |= {"WARC-Type": "warcinfo", "WARC-Record-ID": record_id("warcinfo", url, date), "WARC-Filename": url[11:], "Content-Type": "application/warc-fields"}
        return WarcRecord(headers, f"software: docweave{EOL}format: ARC version {record.version}{EOL}".encode())
    http = split_http(record.block)
    payload = record.block if http is None else http[1]
    digest = sha1_base32(payload)
    headers |= {"WARC-Record-ID": record_id(url, date, sha1_base32(record.block)), "WARC-Target-URI": url, "WARC-IP-Address": record.fields["IP-address"], "WARC-Payload-Digest": f"sha1:{digest}"}
    if http is None:
        headers |= {"WARC-Type": "resource", "Content-Type": record.fields["Content-type"]}
        return WarcRecord(headers | {"WARC-Block-Digest": f"sha1:{digest}"}, record.block)
    headers["Content-Type"] = "application/http; msgtype=response"
    block = record.block
    if original is not None:
        page, address, first = original
        headers |= {"WARC-Type": "revisit", "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(address, date, sha1_base32(first)), "WARC-Refers-To-Target-URI": address, "WARC-Refers-To-Date": date, REFERS: page}
        block = block[: len(block) - len(payload)]
    else:
        headers["WARC-Type"] = "response"
    return WarcRecord(headers | {"WARC-Block-Digest": f"sha1:{sha1_base32(block)}"}, block, http[0], payload)


def parse_warc(stream: BinaryIO, mark_damage: bool = False) -> Iterator[WarcRecord]:
    """The records of a WARC file, taken by their declared lengths. Where it is damaged, an error or, if asked for, a last record of type damaged."""
    try:
        yield from _records(stream)
    except (ValueError, EOFError, OSError, zlib.error) as e:
        if not mark_damage:
            raise
        yield WarcRecord({"WARC-Type": "damaged", "X-Error": str(e)})


def _records(stream: BinaryIO) -> Iterator[WarcRecord]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers, length = {}, 0
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            if name.strip().lower() == "content-length":
                length = int(value)
            else:
                headers[name.strip()] = value.strip()
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"WARC record declares {length} bytes, the file has {len(block)}")
        http, payload = split_http(block) or ({}, block)
        yield WarcRecord(headers, block, http, payload)


def http_block(page: str, body: bytes) -> bytes:
    return f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: {len(body)}{EOL}{PAGE}: {page}{END}".encode() + body


def chunked(records: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    """Rows of gzip members, about CHUNK bytes each, without the last byte."""
    held: list[bytes] = []
    size = 0
    for raw in records:
        held.append(members_ending_in_zero([raw]))
        size += len(held[-1])
        if size >= CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])


def save(rows: DataFrame, path: str) -> None:
    """Write rows of binary values, each followed by a byte of 0."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", CHUNKS).text(path)


def address_of(url: str | None) -> str:
    """A page's address as it comes out of an ARC record line."""
    return record_line(arc_record(1, url or "", "0", b""), 1)[0]["URL"]


def pages_as_warc(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[bytes]:
    """(id, url, html, original, original_url) to WARC records, through ARC files of both versions in turn.

    At most one ARC file, of ARC_BYTES and a page, and one page's records are held.
    """
    files = 0
    arc, name, waiting = io.BytesIO(), "", []

    def converted() -> Iterator[bytes]:
        arc.seek(0)
        records = parse_arc(arc)
        opening = next(records)
        if not files:
            yield to_warc(opening).raw()
        for record, (original, address) in zip(records, waiting, strict=True):
            if original is None:
                yield to_warc(record).raw()
            else:
                payload = (split_http(record.block) or ({}, b""))[1]
                yield to_warc(record, (str(original), address_of(address), http_block(str(original), payload))).raw()

    for batch in batches:
        for i in range(batch.num_rows):
            page, url, html, original, address = (batch.column(c)[i].as_py() for c in ("id", "url", "html", "original", "original_url"))
            version = 1 + files % 2
            if not waiting:
                name = f"pages-{files}.arc"
                arc = io.BytesIO(arc_header(version, name, date))
                arc.seek(0, io.SEEK_END)
            arc.write(arc_record(version, url or "", date, http_block("" if page is None else str(page), (html or "").encode()), arc.tell(), name))
            waiting.append((original, address))
            if arc.tell() >= ARC_BYTES or len(waiting) == ARC_RECORDS:
                yield from converted()
                files, waiting = files + 1, []
    if waiting:
        yield from converted()


def revisits(pages: DataFrame, at_least: int = 0) -> DataFrame:
    """(id, key, original, original_url) of pages whose payload, of at_least bytes, a smaller id has too; of the original's rows the least url counts."""
    keyed, seen = materialise_counted(pages.where(F.octet_length("html") >= at_least).where("id IS NOT NULL").select("id", "key", "url"), "payloads")
    groups = materialise(tree_merge(keyed.select("id", "key"), "min", name="payload-runs").where("group_size > n_keep").select("key", "keep_id", "group_size"), "payload-groups")
    urls = keyed.join(groups.select("key", F.col("keep_id").alias("id")), ["key", "id"]).groupBy("key").agg(F.min(F.coalesce("url", F.lit(""))).alias("original_url"))
    named = materialise(groups.join(urls, "key"), "payload-originals")
    found = skew_join(keyed.select("id", "key"), named, "key", F.col("group_size"), max(seen.n, 1)).where("id > keep_id")
    return found.select("id", "key", F.col("keep_id").alias("original"), "original_url").distinct()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", at_least: int = 0, date: str = "20240101000000") -> str:
    """Write gzip WARC files under path, a response or revisit for each page."""
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    own = own.withColumn("key", F.concat(F.unhex(F.sha2("html", 256)), F.unhex(F.lpad(F.hex(F.octet_length("html").cast("long")), 16, "0"))))
    rows = own.join(revisits(own, at_least), ["id", "key"], "left").select("id", "url", "html", "original", "original_url")
    save(rows.mapInArrow(lambda batches: chunked(pages_as_warc(batches, date)), "value binary"), path)
    return path


def opened(raw: bytes) -> BinaryIO:
    stream = io.BytesIO(raw)
    return gzip.open(stream) if raw[:2] == b"\x1f\x8b" else stream  # type: ignore[return-value]


def convert_arc(spark: SparkSession, source: str, path: str) -> str:
    """Convert the ARC files under source, plain or gzip, to gzip WARC files under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                yield from chunked(to_warc(record).raw() for record in parse_arc(opened(raw.as_py())))

    save(spark.read.format("binaryFile").load(source).select("content").mapInArrow(run, "value binary"), path)
    return path


READ = "type string, record_id string, date string, target string, page_id long, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read_warc(spark: SparkSession, path: str, with_payload: bool = False, mark_damage: bool = False) -> DataFrame:
    """A row for each record, with its payload's bytes where asked for. A response's digest is computed from its payload and must be the declared one.

    A damaged file ends the job or, with mark_damage, gives the records before the damage and one of type damaged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for r in parse_warc(opened(raw.as_py()), mark_damage):
                    kind = (r.header("WARC-Type") or "").lower()
                    declared = (r.header("WARC-Payload-Digest") or "").removeprefix("sha1:")
                    if kind in ("response", "resource") and declared and declared != sha1_base32(r.payload):
                        raise ValueError(f"payload of {r.header('WARC-Record-ID')} doesn't have its declared digest")
                    said = r.http.get("content-length", "")
                    size = int(said) if kind == "revisit" and said.isdigit() else len(r.payload)
                    page, original = r.http.get(PAGE.lower()), r.header(REFERS)
                    rows.append((kind, r.header("WARC-Record-ID"), r.header("WARC-Date"), r.header("WARC-Target-URI"), int(page) if page else None, size, declared, int(original) if original else None, r.payload if with_payload else None))
                    if len(rows) == 256:
                        yield as_rows(rows)
                        rows = []
                if rows:
                    yield as_rows(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def as_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [{"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages as WARC files in the shared folder, read them back: one row for each page."""
    spark = pages.sparkSession
    path = write_warc(pages, fresh_path(spark, "warc"), id_col, url_col, html_col)
    read = read_warc(spark, path).where("type IN ('response', 'revisit')")
    return read.select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
