"""Legacy archives to WARC: read ARC 1 and ARC 2 by declared lengths, write equivalent WARC records, read them back.

An ARC archive opens with a version block, `filedesc://...`, whose body names the version of the header lines that
follow. Version 1: URL, IP address, archive date, content type, archive length. Version 2 adds result code,
checksum, location, offset and file name before the length. A line is read from both ends, so URLs and content
types may hold blanks. The declared length alone decides where a record ends, so bodies may hold anything. Archives may be
plain, one gzip stream, or one gzip member for each record; they are read as a stream, a record at a time.

Each ARC record becomes a WARC record: identifier a name-based UUID of archive, offset and digest, date from
the up to 14 digits, block and payload digests as base32 SHA-1. Records with an HTTP head become `response`, or `revisit` where
an equal payload is kept elsewhere, naming the kept record, its URI and its date; others (dns and the like) become `resource`
with their own content type. Each WARC archive opens with a `warcinfo` record. Of equal payloads of at least
`min_bytes` the one with the largest page id is kept (of those without an id: the largest URL, archive and offset).
The page id is the X-Page-Id field of the HTTP head, which write_arc adds; records without one have none.

A header line that cannot be read, a record whose declared length passes the archive's end and a gzip stream that breaks do not stop a job:
reading goes on at the next line that is a header, and `read_errors` reports archive, place and reason.

Archives are rows (name, version, content) of ARCHIVE_BYTES of payload at most unless one record is larger, so a
lost task rewrites a few archives and no task holds more than one. `export` writes them out as files. Null html
counts as empty, null urls become a `urn:`; null ids stay null. Repeated rows are written each on their own; where the
largest id itself is repeated with one payload, each of its rows is a response. A payload that many records share is met
by broadcast, so no task gathers its copies. An empty table gives no archives. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dist import lean, ship, stage

ARCHIVE_BYTES = 8 << 20
#: The field lines of the two ARC versions.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARCHIVE = "name string, version int, content binary"
_ID = re.compile(rb"^X-Page-Id: (-?\d+)\r?$", re.M)
_START = re.compile(r"(?P<url>\S.*?) (?P<ip>[0-9A-Fa-f.:]+) (?P<date>\d{4,17}) (?P<mime>.*)", re.S)
#: A header line is no longer than this.
_LINE = 1 << 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def http_parts(block: bytes) -> tuple[bytes, bytes]:
    """Head with the blank line, and body; no head where the block is not HTTP."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    ends = [(at, len(mark)) for mark in (b"\r\n\r\n", b"\n\n") if (at := block.find(mark)) >= 0]
    if not ends:
        return block, b""
    at, n = min(ends)
    return block[: at + n], block[at + n :]


def page_of(head: bytes) -> int | None:
    found = _ID.search(head)
    return int(found[1]) if found else None


def gz(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class Stream:
    """Bytes of an archive, plain or gzip members one after the other, taken from the front. """

    def __init__(self, content, step: int = 1 << 14):
        self.view, self.step, self.at = memoryview(content), step, 0
        self.zipped = bytes(self.view[:2]) == b"\x1f\x8b"
        self.held, self.taken, self.error = bytearray(), 0, ""
        self.reader, self.member = None, 0
        #: of each member met so far that is not wholly taken: how many bytes come before it, and its place
        self.starts: list[tuple[int, int]] = []

    def _more(self) -> bool:
        if self.at >= len(self.view):
            if self.reader is not None and not self.error:
                self.error = f"gzip member at {self.member} is cut"
            return False
        if not self.zipped:
            self.held += self.view[self.at : self.at + (1 << 20)]
            self.at += 1 << 20
            return True
        if self.reader is None:
            self.reader, self.member = zlib.decompressobj(31), self.at
            self.starts.append((self.taken + len(self.held), self.at))
        end = min(self.at + self.step, len(self.view))
        try:
            self.held += self.reader.decompress(self.view[self.at : end])
        except zlib.error as e:
            self.error, self.at, self.reader = f"gzip member at {self.member}: {e}", len(self.view), None
            return False
        self.at = end
        if self.reader.eof:
            self.at -= len(self.reader.unused_data)
            self.reader = None
        return True

    def place(self) -> int:
        """Where the next byte is in the archive; inside a gzip member, below 0, one less than the unpacked bytes before it."""
        if not self.held:
            self._more()
        while len(self.starts) > 1 and self.starts[1][0] <= self.taken:
            self.starts.pop(0)
        if not self.starts:
            return self.taken
        before, at = self.starts[0]
        return at if before == self.taken else -1 - self.taken

    def take(self, n: int) -> bytes:
        """The next n bytes; fewer only at the end."""
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        self.taken += len(out)
        return out

    def line(self) -> bytes:
        """Up to and with the next line feed, _LINE bytes at most."""
        end = self.held.find(b"\n")
        while end < 0 and len(self.held) < _LINE and self._more():
            end = self.held.find(b"\n")
        return self.take(min(end + 1 if end >= 0 else len(self.held), _LINE))

    def has(self, n: int) -> bool:
        while len(self.held) < n and self._more():
            pass
        return len(self.held) >= n


# ARC


def arc_head(name: str, version: int, date: str) -> bytes:
    body = f"{version} {0 if version == 1 else 1} papyra\n{ARC_FIELDS[version]}\n".encode()
    start = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"]
    return _arc_line(start, version, 200, "-", 0, name, len(body)) + body + b"\n"


def _arc_line(start: list[str], version: int, code: int, checksum: str, at: int, name: str, length: int) -> bytes:
    more = [str(code), checksum, "-", str(at), name] if version == 2 else []
    return " ".join([*start, *more, str(length)]).encode() + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, block: bytes, at: int, name: str) -> bytes:
    return _arc_line([url, ip, date, "text/html"], version, 200, hashlib.md5(block).hexdigest(), at, name, len(block)) + block + b"\n"


def arc_line(line: bytes, version: int) -> dict[str, str] | None:
    """A header line's fields by name; None if it is none."""
    names = ARC_FIELDS[version].split()
    parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 4)
    start = _START.fullmatch(parts[0])
    if not start or len(parts) != len(names) - 3 or not re.fullmatch("[0-9]{1,18}", parts[-1]):
        return None
    return dict(zip(names, [*start.group("url", "ip", "date", "mime"), *parts[1:]], strict=True))


def scan_arc(content) -> Iterator[tuple[int, dict[str, str] | None, bytes]]:
    """Place, header fields by name, and block of each record; for what cannot be read the place, None and the reason."""
    stream, version, lost = Stream(content), 1, False
    while True:
        at = stream.place()
        line = stream.line()
        if not line:
            break
        if not line.strip():
            continue
        head = arc_line(line, version) or arc_line(line, 3 - version)
        if head is None:
            if not lost:
                yield at, None, b"no ARC header: " + line[:200].rstrip()
            lost = True
            continue
        length = int(head["Archive-length"])
        if not stream.has(length):
            yield at, None, b"record of %d bytes is cut" % length
            lost = True
            continue
        lost = False
        block = stream.take(length)
        if not line.startswith(b"filedesc://"):
            yield at, head, block
        elif block[:1] in (b"1", b"2"):
            version = int(block[:1])
        else:
            yield at, None, b"unknown ARC version " + block[:20]
    if stream.error:
        yield len(content), None, stream.error.encode()


def read_arc(content) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, header fields by name, and block of each record that can be read."""
    return (r for r in scan_arc(content) if r[1] is not None)


def _write_arc(version_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, version, parts, size, at, seq = "", 1, [], 0, 0, 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([version], pa.int32()), pa.array([b"".join(parts)], pa.binary())], ["name", "version", "content"])

        for batch in batches:
            for page, url, date, html in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                payload = html.encode() if html is not None else b""
                if parts and size + len(payload) > ARCHIVE_BYTES:
                    yield done()
                    parts = []
                if not parts:
                    version, size, seq = version_of(page), 0, seq + 1
                    name = f"{uuid.uuid5(uuid.NAMESPACE_URL, f'{TaskContext.get().partitionId()}:{seq}:{page}:{url}')}.arc.gz"
                    parts.append(gz(arc_head(name, version, date)))
                    at = len(parts[0])
                where = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else f"urn:page:{page}" if page is not None else f"urn:arc:{name}:{at}"
                parts.append(gz(arc_record(version, where, "0.0.0.0", date, http_block(page, payload), at, name)))
                at += len(parts[-1])
                size += len(payload)
        if parts:
            yield done()

    return run


def write_arc(pages: DataFrame, date: str = "20200101000000") -> DataFrame:
    """Legacy archives of page_id, url, html, of version 2 where the first page's id is odd, else 1."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.lit(date).alias("date"), F.col("html").cast("string"))
    return rows.mapInArrow(lean(_write_arc(lambda page: 1 + (page or 0) % 2)), ARCHIVE)


# WARC


def warc_date(digits: str) -> str:
    d = digits[:14] + "00000101000000"[len(digits[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}).items())
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def warcinfo(name: str, date: str) -> bytes:
    block = b"software: papyra\r\nformat: WARC File Format 1.1\r\n"
    fields = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{record_id(name, 0, 'warcinfo')}>", "WARC-Date": warc_date(date), "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return _record(fields, block)


def warc_record(url: str, date: str, ip: str, mime: str, block: bytes, payload_digest: str, name: str, at: int, kept: dict | None = None) -> bytes:
    """response, revisit (kept: name, at, url, date and page_id of the record that holds the payload) or resource."""
    head, body = http_parts(block)
    kind = "resource" if not head else "revisit" if kept else "response"
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<{record_id(name, at, payload_digest)}>",
        "WARC-Date": warc_date(date),
        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"),
        "WARC-IP-Address": ip,
        "WARC-Payload-Digest": f"sha1:{payload_digest}",
        "Content-Type": "application/http; msgtype=response" if head else mime.strip() or "application/octet-stream",
    }
    if kind == "revisit":
        fields |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": f"<{record_id(kept['name'], kept['at'], payload_digest)}>",
            "WARC-Refers-To-Target-URI": quote(kept["url"], safe=":/?#[]@!$&'()*+,;=%~-._"),
            "WARC-Refers-To-Date": warc_date(kept["date"]),
            "X-Payload-Length": str(len(body)),
        }
        if kept["page_id"] is not None:
            fields["X-Refers-To-Page-Id"] = str(kept["page_id"])
        block = head
    return _record(fields, block)


def record_id(name: str, at: int, payload_digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{at}#{payload_digest}')}"


def read_warc(content) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; a damaged one is an error."""
    stream = Stream(content)
    while True:
        at, version = stream.place(), stream.line()
        if not version:
            break
        if not version.strip():
            continue
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {}
        while (line := stream.line()).strip():
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            fields[name] = value.strip()
        length = int(fields["Content-Length"])
        block = stream.take(length)
        if len(block) < length or f"sha1:{digest(block)}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"WARC record at {at} is damaged")
        yield fields, block
    if stream.error:
        raise ValueError(stream.error)


PLACE = "name string, at long, url string, date string, page_id long"
_PLACE = [("name", pa.string()), ("at", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("page_id", pa.int64())]
_PAYLOAD = [("sha1", pa.string()), ("size", pa.int64())]
_BODY = [("ip", pa.string()), ("mime", pa.string()), ("block", pa.binary())]


def _table(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def _parse(whole: bool):
    """The records of archives; whole: with their blocks, else only places and digests of those with an HTTP head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for at, head, block in read_arc(content.as_buffer()):
                    http, body = http_parts(block)
                    row = (name, at, head["URL"], head["Archive-date"], page_of(http), digest(body), len(body))
                    if whole:
                        rows.append((*row, head["IP-address"], head["Content-type"], block))
                    elif http:
                        rows.append(row)
                yield _table(rows, [*_PLACE, *_PAYLOAD, *(_BODY if whole else [])])

    return run


def read_errors(arcs: DataFrame) -> DataFrame:
    """name, at and error of everything in the archives that could not be read."""
    ship(arcs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                yield _table([(name, at, why.decode("utf-8", "replace")) for at, head, why in scan_arc(content.as_buffer()) if head is None], [("name", pa.string()), ("at", pa.int64()), ("error", pa.string())])

    return arcs.select("name", "content").mapInArrow(lean(run), "name string, at long, error string")


def _write_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size, name = [], 0, ""

    def done():
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([0], pa.int32()), pa.array([b"".join(parts)], pa.binary())], ["name", "version", "content"])

    for batch in batches:
        for arc, at, url, date, block, ip, mime, sha, kept in zip(*(batch.column(c).to_pylist() for c in ("name", "at", "url", "date", "block", "ip", "mime", "sha1", "kept")), strict=True):
            if parts and size + len(block) > ARCHIVE_BYTES:
                yield done()
                parts, size = [], 0
            if not parts:
                name = f"{uuid.uuid5(uuid.NAMESPACE_URL, f'{arc}#{at}')}.warc.gz"
                parts.append(gz(warcinfo(name, date)))
            parts.append(gz(warc_record(url, date, ip, mime, block, sha, arc, at, kept)))
            size += len(block)
    if parts:
        yield done()


def convert(arcs: DataFrame, min_bytes: int = 0) -> DataFrame:
    """WARC archives of ARC archives. Of equal payloads the one with the largest page id is written whole."""
    spark = arcs.sparkSession
    ship(spark)
    arcs = arcs.select("name", "content")
    seen = arcs.mapInArrow(lean(_parse(False)), f"{PLACE}, sha1 string, size long")
    # the largest of each group, counted before the shuffle; most payloads have no equal and drop out
    place = F.struct("page_id", "url", "name", "at", "date")
    groups = seen.groupBy("sha1", "size").agg(F.max(place).alias("kept"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.col("size") >= min_bytes))
    groups = stage(groups, "kept")
    # payloads with more than an even partition's share of the copies: fewer than there are partitions
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = max(100, (groups.agg(F.sum("n")).first()[0] or 0) // max(1, partitions))
    often = F.broadcast(groups.where(F.col("n") > many).select(F.col("sha1").alias("often_sha1"), F.col("size").alias("often_size"), F.col("kept").alias("often_kept")))
    rest = groups.where(F.col("n") <= many).select(F.concat_ws(":", "sha1", "size").alias("kept_key"), "kept")
    records = arcs.mapInArrow(lean(_parse(True)), f"{PLACE}, sha1 string, size long, ip string, mime string, block binary")
    own = records.join(often, (F.col("sha1") == F.col("often_sha1")) & (F.col("size") == F.col("often_size")), "left")
    key = F.when(F.col("often_sha1").isNull(), F.concat_ws(":", "sha1", "size")).otherwise(F.concat_ws("#", "name", "at"))
    own = own.withColumn("own_key", key).join(rest, F.col("own_key") == F.col("kept_key"), "left").withColumn("kept", F.coalesce("often_kept", "kept"))
    itself = F.when(F.col("kept.page_id").isNull(), (F.col("kept.name") == F.col("name")) & (F.col("kept.at") == F.col("at"))).otherwise(F.col("kept.page_id").eqNullSafe(F.col("page_id")))
    own = own.withColumn("kept", F.when(~itself, F.col("kept")))
    return own.select("name", "at", "url", "date", "block", "ip", "mime", "sha1", "kept").mapInArrow(lean(_write_warc), ARCHIVE)


_READ = [("name", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("refers_to_id", pa.string())]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
            rows = []
            for head, block in read_warc(content.as_buffer()):
                kind = head["WARC-Type"]
                if kind == "warcinfo":
                    continue
                http, body = http_parts(block)
                if kind != "revisit" and f"sha1:{digest(body)}" != head["WARC-Payload-Digest"]:
                    raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                length = int(head["X-Payload-Length"]) if kind == "revisit" else len(body)
                refers = head.get("X-Refers-To-Page-Id")
                rows.append((name, head["WARC-Record-ID"].strip("<>"), page_of(http), head["WARC-Target-URI"], head["WARC-Date"], length, head["WARC-Payload-Digest"].removeprefix("sha1:"), kind, None if refers is None else int(refers), head.get("WARC-Refers-To", "").strip("<>") or None))
            yield _table(rows, _READ)


def read_records(warcs: DataFrame) -> DataFrame:
    """A row per WARC record but warcinfo, checked against its digests."""
    ship(warcs.sparkSession)
    return warcs.select("name", "content").mapInArrow(lean(_records), "name string, record_id string, page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_id string")


def export(archives: DataFrame, uri: str) -> DataFrame:
    """Write each archive as a file below uri (any store that pyarrow opens); rows of name and bytes. Same content for a repeated task."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                part = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{base}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64())], ["name", "bytes"])

    return archives.select("name", "content").mapInArrow(lean(run), "name string, bytes long")
