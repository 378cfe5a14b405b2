"""Legacy archives: ARC files to WARC files and back to rows.

An ARC file starts with a version block that names its version and the fields of its record lines; each record is
such a line, then as many bytes as the line declares. Version 1 lines have five fields, version 2 lines ten. Records
become WARC/1.1 responses, or revisits of another record with the same payload, with identifiers, dates, types and
digests made from what the ARC record holds.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import BLOCK, bounded_batches, kept, new_path, remove, scratch, stored

# The names of the fields of record lines by version, and the profile of revisits.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length".split(),
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length".split(),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
#: Bytes of records that one archive file holds, about.
ARCHIVE_BYTES = 8 << 20
#: How archives are zipped. Level 4 of zlib makes pages 4 % longer than the default, 6, in two fifths of the time.
ZIPPED = {"compression": "gzip", "zlib.compress.level": "FOUR"}


class ArchiveError(ValueError):
    """The bytes are no archive of the kind."""


@dataclass(frozen=True)
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes


def arc_bytes(records: list[ArcRecord], version: int, name: str = "pages.arc") -> bytes:
    """An ARC file of the given version."""
    head = f"{version} 0 folio\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 19960923142103 text/plain ".encode() + (b"" if version == 1 else f"200 - - 0 {name} ".encode()) + f"{len(head)}\n".encode() + head]
    at = len(out[0])
    for r in records:
        middle = [] if version == 1 else ["200", hashlib.md5(r.block).hexdigest(), "-", str(at), name]
        out.append(" ".join([r.url, r.ip, r.date, r.content_type, *middle, str(len(r.block))]).encode() + b"\n" + r.block + b"\n")
        at += len(out[-1])
    return b"".join(out)


class Stream:
    """An archive's bytes, unzipped as they are read, member by member, and the place reached in the unzipped bytes."""

    def __init__(self, data: bytes) -> None:
        raw = io.BytesIO(data)
        self.source = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data.startswith(b"\x1f\x8b") else raw
        self.at = 0

    def line(self) -> bytes | None:
        """The next line that isn't empty, without its end; None if there is none."""
        while True:
            got = self.source.readline()
            self.at += len(got)
            if not got:
                return None
            if not got.endswith(b"\n"):
                raise ArchiveError("a line ends early")
            if line := got.rstrip(b"\r\n"):
                return line

    def take(self, size: int) -> bytes:
        got = self.source.read(size)
        self.at += len(got)
        if len(got) < size:
            raise ArchiveError("a record ends early")
        return got


def read_arc(data: bytes | Stream) -> Iterator[ArcRecord]:
    """The records of an ARC file: its version block says how lines are read, each line how many bytes follow."""
    stream = data if isinstance(data, Stream) else Stream(data)
    line = stream.line()
    if line is None:
        return
    parts = line.split(b" ")
    if not parts[0].startswith(b"filedesc://") or not parts[-1].isdigit():
        raise ArchiveError("no version block")
    head = stream.take(int(parts[-1])).decode("utf-8", "replace").split("\n")
    version = head[0].split(" ")[0]
    if not version.isdigit() or int(version) not in ARC_FIELDS:
        raise ArchiveError(f"version {version[:20]}")
    fields = head[1].split(" ") if len(head) > 1 and head[1] else ARC_FIELDS[int(version)]
    if set(ARC_FIELDS[1]) - set(fields):
        raise ArchiveError("the version block doesn't name the fields")
    place = {x: k for k, x in enumerate(fields)}
    while (line := stream.line()) is not None:
        parts = line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1)  # a URL may hold blanks
        if len(parts) != len(fields) or not parts[place["Archive-length"]].isdigit():
            raise ArchiveError(f"no record line: {line[:80]!r}")
        block = stream.take(int(parts[place["Archive-length"]]))
        yield ArcRecord(parts[place["URL"]], parts[place["IP-address"]], parts[place["Archive-date"]], parts[place["Content-type"]], block)


def quarantined(records: Iterator, stream: Stream) -> Iterator[tuple[object, str | None]]:
    """(record, None) of each record that can be read, then, if one can't, (the place where it begins, the reason)."""
    begins = stream.at
    try:
        for record in records:
            yield record, None
            begins = stream.at
    except (ArchiveError, OSError, EOFError, zlib.error, ValueError, KeyError) as error:
        yield begins, f"{type(error).__name__}: {error}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def warc_date(arc_date: str) -> str:
    """Fourteen, twelve or eight digits to an ISO time; what is missing is zero."""
    d = (re.sub(r"\D", "", arc_date) + "0" * 14)[:14]
    month, day = max(d[4:6], "01"), max(d[6:8], "01")
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header with its blank line, and payload; a block without an HTTP header is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    cut = block.find(END)
    return (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (block, b"")


def row_of(block: bytes) -> int | None:
    """The number that the HTTP header of a block gives its page, if any."""
    found = _ROW.search(split_http(block)[0])
    return int(found[1]) if found else None


_ROW = re.compile(rb"^X-Row: (-?\d+)\r$", re.M)


def warc_record(arc: ArcRecord, name: str, row: int | None, refers_to: int | None) -> bytes:
    """The WARC record, without its closing blank lines, of an ARC record; a revisit keeps the HTTP header only.

    A page that has a number is named by it, others by name.
    """
    head, payload = split_http(arc.block)
    http = bool(head)
    block = head if refers_to is not None else arc.block
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response' if http else 'resource'}",
        f"WARC-Record-ID: {record_id(name if row is None else f'row:{row}')}",
        f"WARC-Date: {warc_date(arc.date)}",
        f"WARC-Target-URI: {arc.url}",
        f"WARC-IP-Address: {arc.ip}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"Content-Type: {'application/http; msgtype=response' if http else arc.content_type}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if row is not None:
        lines.append(f"X-Row: {row}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(f'row:{refers_to}')}", f"X-Refers-To-Row: {refers_to}", "WARC-Truncated: length"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "replace") + END + block


def read_warc(data: bytes | Stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record, by the declared lengths."""
    stream = data if isinstance(data, Stream) else Stream(data)
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            raise ArchiveError("no WARC record")
        headers: dict[str, str] = {}
        while True:
            got = stream.source.readline()
            stream.at += len(got)
            if not got.endswith(b"\n"):
                raise ArchiveError("a header ends early")
            got = got.rstrip(b"\r\n").decode("utf-8", "replace")
            if not got:
                break
            name, colon, value = got.partition(":")
            if colon:
                headers[name.lower()] = value.strip()
        if not headers.get("content-length", "").isdigit():
            raise ArchiveError("a record without its length")
        yield headers, stream.take(int(headers["content-length"]))


_ARC_RECORD = "name string, url string, ip string, date string, type string, block binary"


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as the text of ARC files of about ARCHIVE_BYTES, of either version in turn."""
    records, size, version = [], 0, 1
    for batch in batches:
        for row, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
            payload = (html or "").encode("utf-8", "surrogatepass")
            number = "" if row is None else f"X-Row: {row}\r\n"
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}Content-Length: {len(payload)}\r\n\r\n".encode()
            records.append(ArcRecord(re.sub(r"[\r\n]", "", url or "urn:none"), "0.0.0.0", "20240101000000", "text/html", head + payload))
            size += len(payload)
            if size >= ARCHIVE_BYTES:
                yield _text(arc_bytes(records, version))
                records, size, version = [], 0, 3 - version
    if records:
        yield _text(arc_bytes(records, version))


def _text(*values: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "surrogatepass") for x in values], pa.string())], ["value"])


def write_arcs(pages: DataFrame, path: str) -> None:
    """Writes pages (page_id, url, html) as gzipped ARC files of either version."""
    bounded_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages.mapInArrow(_filed, "value string").write.options(**ZIPPED).option("maxRecordsPerFile", 1).text(path)


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[str, Stream]]:
    for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
        yield path, Stream(content.as_py() or b"")


def _records(stream: Stream, path: str) -> Iterator[tuple[str, ArcRecord | int, str | None]]:
    """(name, record, None), or (name, place, reason) of the first that can't be read."""
    name = path.rpartition("/")[2]
    for k, (record, reason) in enumerate(quarantined(read_arc(stream), stream)):
        yield f"{name}:{k}", record, reason


def _read_arcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, stream in _opened(batch):
            own: list[tuple] = []
            size = 0
            for name, r, reason in _records(stream, path):
                if reason is None:
                    own.append((name, r.url, r.ip, r.date, r.content_type, r.block))
                    size += len(r.block)
                if size > BLOCK:
                    yield _rows(own)
                    own, size = [], 0
            yield _rows(own)


def _rows(own: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in own], kind) for k, kind in enumerate(kinds)], ["name", "url", "ip", "date", "type", "block"])


_SUMS = "path string, name string, row long, digest string, size long, offset long, reason string"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for path, stream in _opened(batch):
            own = []
            for name, r, reason in _records(stream, path):
                if reason is not None:
                    own.append((path, name, None, None, None, r, reason))
                else:
                    payload = split_http(r.block)[1]
                    own.append((path, name, row_of(r.block), digest(payload), len(payload), None, None))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], kind) for k, kind in enumerate(kinds)], [c.split()[0] for c in _SUMS.split(", ")])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """(name, url, ip, date, type, block): the records of the ARC files in path; name is the file's with the record's number.

    Files may be zipped as a whole or record by record; they are unzipped as they are read. Of a file that is cut or broken the
    records before the fault count; convert_arcs() tells where it is.
    """
    bounded_batches(spark)
    return _files(spark, path).mapInArrow(_read_arcs, _ARC_RECORD)


def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The WARC records of each ARC file, whose revisits come beside it."""
    for batch in batches:
        for (path, stream), links in zip(_opened(batch), batch.column("links"), strict=True):
            refers = {x["name"]: x["refers_to"] for x in links.as_py() or ()}
            own: list[bytes] = []
            size = 0
            for name, r, reason in _records(stream, path):
                if reason is None:
                    own.append(warc_record(r, name, row_of(r.block), refers.get(name)))
                    size += len(own[-1])
                if size > BLOCK:
                    yield _text(*own)
                    own, size = [], 0
            yield _text(*own)


def revisits(sums: DataFrame, least: int = 0) -> DataFrame:
    """(path, name, refers_to) of the records whose payload, of at least so many bytes, one with a larger row has too: the largest such row."""
    shared = sums.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("row").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return sums.join(shared, ["digest", "size"]).where("row < refers_to").select("path", "name", "refers_to")


def convert_arcs(spark: SparkSession, source: str, path: str, least: int = 0) -> DataFrame:
    """Converts the ARC files in source to gzipped WARC files of about ARCHIVE_BYTES before compression.

    A WARC file is written as a text file whose lines end in the blank lines that close a record. Records whose HTTP header
    gives no X-Row number are responses (or resources, without such a header), never revisits. Returns the quarantine, (name,
    offset, reason): the first record of each file that cannot be read, the place in the unzipped file from which on, and why. It and what
    follows in its file are left out, all else is converted. The table goes with the session, or by discard().
    """
    bounded_batches(spark)
    with scratch(spark):
        sums = stored(_files(spark, source).mapInArrow(_summed, _SUMS), "sums")
        good = sums.where("reason is null")
        size = good.agg(F.count("*").alias("n"), F.sum("size").alias("b")).first()
        each = (size["b"] or 0) / max(size["n"], 1) + 600
        # Files travel zipped to the revisits of their records; the records themselves are never shuffled.
        links = revisits(good, least).groupBy("path").agg(F.collect_list(F.struct("name", "refers_to")).alias("links"))
        records = _files(spark, source).join(links.hint("shuffle_hash"), "path", "left").select("path", "content", "links").mapInArrow(_converted, "value string")
        records.write.option("lineSep", END.decode()).options(**ZIPPED).option("maxRecordsPerFile", max(1, int(ARCHIVE_BYTES / each))).text(path)
        return kept(stored(sums.where("reason is not null").select("name", "offset", "reason"), "quarantine"))


def _row(headers: dict[str, str], block: bytes) -> dict:
    revisit = headers["warc-type"] == "revisit"
    payload = None if revisit else split_http(block)[1]
    found = headers["warc-payload-digest"].removeprefix("sha1:")
    if payload is not None and digest(payload) != found:
        raise ArchiveError(f"{headers['warc-record-id']}: the payload isn't that of its digest")
    return {
        "page_id": int(headers["x-row"]) if "x-row" in headers else None,
        "payload_bytes": len(payload) if payload is not None else int(headers["x-payload-length"]),
        "payload_digest": found,
        "record_type": headers["warc-type"],
        "refers_to": int(headers["x-refers-to-row"]) if revisit else None,
        "url": headers["warc-target-uri"],
        "warc_date": headers["warc-date"],
        "record_id": headers["warc-record-id"],
    }


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, stream in _opened(batch):
            rows: list[dict] = []
            for record, reason in quarantined(read_warc(stream), stream):
                begins = stream.at
                if reason is None:
                    try:
                        rows.append(_row(*record))
                        continue
                    except (ArchiveError, KeyError, ValueError) as error:  # this record alone is unsound
                        record, reason = begins - len(record[1]), f"{type(error).__name__}: {error}"
                rows.append({"file": path.rpartition("/")[2], "offset": record, "reason": reason})
            yield pa.RecordBatch.from_pylist(rows, _READ)


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("warc_date", pa.string()), ("record_id", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("reason", pa.string())])
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, warc_date string, record_id string, file string, offset long, reason string"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files in path; digests of responses are checked against their payloads.

    reason is null, but for a record that can't be read, whose row has file, offset (in the unzipped file; that of the block, if the
    headers could be read) and reason alone. What follows it in its file is left out, unless only its contents are unsound.
    """
    bounded_batches(spark)
    return _files(spark, path).mapInArrow(_parsed, READ)


def archived(pages: DataFrame) -> DataFrame:
    """The rows of pages as read back from WARC files, to which ARC files written of them were converted.

    Null html is an empty payload and a null url is urn:none. Of equal payloads the largest page_id, and each row that
    repeats it, is a response; rows without a page_id are responses too. page_id is cast to long. No rows give no rows.
    Only page_id, url and html are read. The archives are deleted.
    """
    spark = pages.sparkSession
    with scratch(spark):
        arcs, warcs = new_path(spark, "arc"), new_path(spark, "warc")
        write_arcs(pages, arcs)
        remove(spark, convert_arcs(spark, arcs, warcs)._folio_path)  # a record that is quarantined is missing below
        rows = stored(read_archives(spark, warcs), "records")
        told = rows.agg(F.count_if(F.col("reason").isNull()), F.max("reason")).first()
        if told[1] or told[0] != pages.count():
            raise ArchiveError(f"{told[0]} pages came back: {told[1] or 'some are missing'}")
        return kept(rows).drop("file", "offset", "reason")
