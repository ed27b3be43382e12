"""WARC archives written by Spark's text writer, and a reader that salvages what damage leaves.

The writer makes records of WARC 1.1 as plain column expressions; a record's end mark is the writer's line separator,
so part files are archives as they are. The reader checks every record's lengths, end mark and block digest. After a
failed check it looks for the next gzip member or version line whose record passes, goes on there, and reports the
bytes between as a quarantined gap. Members are inflated piece by piece, and one record is held at a time.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork.shared import shared_path, written

#: Payloads from so many bytes on are stored once.
REVISIT_BYTES = 1000
#: Records in a file, bytes of a file, about, and owners of payloads that may be broadcast (about 150 bytes each); more are
#: joined by a shuffle. A payload of over FILE_BYTES / FILE_RECORDS goes to files of fewer records.
FILE_RECORDS, FILE_BYTES, BROADCAST_OWNERS = 1000, 256 << 20, 100_000
#: Bytes of a gzip member that are inflated at a time, and bytes that come out of them at most.
PIECE, PULLED = 1 << 16, 1 << 20
DATE = "2000-01-01T00:00:00Z"
END_MARK = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROWS = "kind string, file string, offset long, length long, record_id string, page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to_id string, refers_to long, payload binary, reason string"


def _header(*lines: tuple[str, Column]) -> Column:
    """Header lines; one whose value is null is left out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in lines))


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def plan_records(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, refers_to``, one row for each row of ``df``.

    Of equal payloads of REVISIT_BYTES and more, the rows of the largest id are stored and all others refer to it; a
    null id is less than any other, and where all ids are null all are stored. Payloads are told apart by SHA-256. Repeated rows of the largest id are
    each stored. A null page is an empty payload.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = df.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"),
        F.when(F.octet_length(payload) >= REVISIT_BYTES, F.sha2(payload.cast("binary"), 256)).alias("same"),
    )
    large = rows.where("same is not null").groupBy("same")
    owners = written(large.agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1 and owner is not null").drop("n"), "payload-owners")
    if owners.count() <= BROADCAST_OWNERS:
        owners = F.broadcast(owners)
    owned = rows.join(owners, "same", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))
    return owned.withColumn("refers_to", refers).drop("owner", "same")


def write_archives(df: DataFrame, path: str, date: str = DATE, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a record for each row. Blanks and control characters of an address are percent-encoded; a null address
    has no line. An empty table gives no records."""
    rows = plan_records(df, page_id, url, html)
    uri = F.col("url")
    for character in "\r\n\t\0 ":
        uri = F.replace(uri, F.lit(character), F.lit(f"%{ord(character):02X}"))
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"),
        _header(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _header(
            ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            ("WARC-Record-ID", _record_id(F.col("page_id"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", digest),
            ("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block.cast("binary")))),
            ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length(block).cast("string")),
        ),
        F.lit("\r\n"),
    )
    small = FILE_BYTES // FILE_RECORDS
    largest = df.agg(F.max(F.octet_length(html))).first()[0] or 1
    tiers = [(F.col("payload_bytes") <= small, FILE_RECORDS)] + [(F.col("payload_bytes") > small, max(1, FILE_BYTES // largest))] * (largest > small)
    for tier, most in tiers:
        records = rows.where(tier).select(F.concat(head, block).alias("value"))
        records.write.mode("append").option("lineSep", END_MARK.decode()).option("maxRecordsPerFile", most).text(path)


_START = re.compile(rb"\x1f\x8b\x08[\x00-\x1f]|(?:(?<=\n)|\A)WARC/1\.[01]\r\n")
_VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
_RECORD_ID = re.compile("<[A-Za-z][A-Za-z0-9+.-]*:[^<>\\s]+>")


def _agrees(digest: str, block: bytes) -> bool:
    """Whether a labelled digest, in hexadecimal or Base32, is the block's. Labels of unknown algorithms aren't checked."""
    name, _, value = digest.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return True
    own = hashlib.new(name, block).digest()
    value = value.strip()
    return value.lower() == own.hex() or value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=")


class _Bytes:
    """Bytes that records are read from, by their places."""

    def __init__(self, data: bytes):
        self.held, self.first = data, 0

    def pull(self) -> bool:
        """Hold more, if there is any."""
        return False

    def forget(self, before: int) -> None:
        """What stands before a place isn't asked for again."""

    def has(self, end: int) -> bool:
        while self.first + len(self.held) < end:
            if not self.pull():
                return False
        return True

    def cut(self, start: int, end: int) -> bytes:
        return bytes(self.held[start - self.first : end - self.first])

    def find(self, what: bytes, start: int) -> int:
        """The first place from ``start`` on, or -1."""
        while True:
            at = self.held.find(what, start - self.first)
            if at >= 0:
                return at + self.first
            start = max(start, self.first + len(self.held) - len(what) + 1)
            if not self.pull():
                return -1

    def version_line(self, start: int) -> int:
        """The next version line, or -1."""
        at = start - 1
        while (at := self.find(b"\nWARC/1.", at)) >= 0:
            self.forget(at)
            if self.has(at + 11) and self.cut(at + 1, at + 11) in _VERSIONS:
                return at + 1
            at += 1
        return -1


class _Member(_Bytes):
    """The content of the gzip member at a place, inflated as it is asked for; what has been read is given up. ``reason`` says
    why the member is bad, once it has been read; what came out before an error is held all the same."""

    def __init__(self, data: bytes, at: int):
        super().__init__(bytearray())
        self.data, self.fed, self.tail, self.end, self.reason = data, self._body(data, at), b"", -1, ""
        self.unpack, self.sum, self.size = zlib.decompressobj(-15), 0, 0
        if self.fed < 0:
            self.end, self.reason = at, "bad member: no gzip header"

    @staticmethod
    def _body(data: bytes, at: int) -> int:
        """Where the deflated bytes begin, or -1."""
        flags = data[at + 3] if len(data) > at + 10 and data[at + 2] == 8 else 0xFF
        if flags & 0xE0:
            return -1
        at += 10
        if flags & 4:
            at += 2 + int.from_bytes(data[at : at + 2], "little")
        for bit in (8, 16):
            if flags & bit:
                at = data.find(b"\0", at) + 1
                if not at:
                    return -1
        return at + 2 * bool(flags & 2)

    def _take(self, out: bytes) -> None:
        self.held += out
        self.sum, self.size = zlib.crc32(out, self.sum), self.size + len(out)

    def pull(self) -> bool:
        if self.end >= 0:
            return False
        piece = self.tail or self.data[self.fed : self.fed + PIECE]
        self.fed += 0 if self.tail else len(piece)
        if not piece:
            self.end, self.reason = len(self.data), "member without an end"
            return False
        before = self.unpack.copy()
        try:
            self._take(self.unpack.decompress(piece, PULLED))
            self.tail = self.unpack.unconsumed_tail
        except zlib.error as e:
            self.end, self.reason = self.fed, f"bad member: {e}"
            with contextlib.suppress(zlib.error):
                for i in range(len(piece)):
                    self._take(before.decompress(piece[i : i + 1]))
            return True
        if self.unpack.eof:
            self.end = self.fed - len(self.unpack.unused_data) + 8
            if self.data[self.end - 8 : self.end] != self.sum.to_bytes(4, "little") + (self.size % (1 << 32)).to_bytes(4, "little"):
                self.reason = "bad member: its checksum or length differs"
        return True

    def forget(self, before: int) -> None:
        if before - self.first > PULLED:
            del self.held[: before - self.first]
            self.first = before


def _record(source: _Bytes, at: int) -> tuple[int, dict[str, str], bytes] | str:
    """The end, headers and block of the record at a place, or why there is none. Header lines are read up to the first bad
    one, which a further version line is, so lines that only look like records cost no second reading."""
    if not source.has(at + 10) or source.cut(at, at + 10) not in _VERSIONS:
        return "no version line"
    headers, begin = {}, at + 10
    while True:
        end = source.find(b"\r\n", begin)
        if end < 0:
            return "no end of headers"
        line, begin = source.cut(begin, end), end + 2
        if not line:
            break
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            return "bad header line"
        headers[name.strip().lower()] = value.strip()
    if not re.fullmatch("[0-9]{1,18}", headers.get("content-length", "")):
        return "bad length"
    if "warc-type" not in headers or not _RECORD_ID.fullmatch(headers.get("warc-record-id", "")):
        return "bad type or record id"
    end = begin + int(headers["content-length"])
    if not source.has(end + len(END_MARK)) or source.cut(end, end + len(END_MARK)) != END_MARK:
        return "no end mark after the block"
    block = source.cut(begin, end)
    digest = headers.get("warc-block-digest")
    if digest is not None and not _agrees(digest, block):
        return "block digest differs"
    return end + len(END_MARK), headers, block


def _within(source: _Member) -> Iterator[tuple[str, int, dict[str, str], bytes, str]]:
    """``(kind, length, headers, block, reason)`` of a member's content. Of a bad member, what follows the last record is no
    gap of its own."""
    at, gap, why = 0, -1, ""
    while source.has(at + 1):
        found = _record(source, at)
        if isinstance(found, str):
            if gap < 0:
                gap, why = at, found
            following = source.version_line(at + 1)
            at = following if following >= 0 else source.first + len(source.held)
            source.forget(at - 1)
            continue
        if gap >= 0:
            yield "gap", at - gap, {}, b"", why
            gap = -1
        yield "record", found[0] - at, found[1], found[2], ""
        at = found[0]
        source.forget(at - 1)
    if gap >= 0 and not source.reason:
        yield "gap", at - gap, {}, b"", why


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str], bytes, str]]:
    """``(kind, offset, length, headers, block, reason)`` of an archive: records in order, and gaps between them.

    What stands in a gzip member has the member's place, and its own length as inflated. A member is read as it inflates,
    of any size, record by record. Of a bad member the records that pass are given, and the member is a gap besides, up to
    the next member or version line.
    """
    whole, at, gap, why = _Bytes(data), 0, -1, ""
    while at < len(data):
        if data[at : at + 2] == b"\x1f\x8b":
            member = _Member(data, at)
            for item in _within(member):
                if gap >= 0:
                    yield "gap", gap, at - gap, {}, b"", why
                    gap = -1
                yield item[0], at, *item[1:]
            found = member.reason or (member.end,)
        else:
            found = _record(whole, at)
        if isinstance(found, str):
            if gap < 0:
                gap, why = at, found
            following = _START.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap >= 0:
            yield "gap", gap, at - gap, {}, b"", why
            gap = -1
        if len(found) > 1:
            yield "record", at, found[0] - at, found[1], found[2], ""
        at = found[0]
    if gap >= 0:
        yield "gap", gap, len(data) - gap, {}, b"", why


def _page(urn: str | None) -> int | None:
    found = re.fullmatch("<urn:page:(-?[0-9]+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True, spoil: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """All records and gaps of the archives in a folder (columns ROWS), of what ``spoil`` makes of them if it is given.

    ``record_id`` and ``refers_to_id`` are as the headers have them; ``page_id`` and ``refers_to`` are the pages that this
    writer's ids name.
    A response's digest and length are those of the payload that was read; a revisit has those of the full payload
    from its headers. ``kind`` is record or gap; a gap has its place, length and reason only. Files are read whole,
    each by one task; the writer bounds the records of a file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                whole = content.as_buffer().to_pybytes() if spoil is None else spoil(content.as_py())
                items = salvage(whole)
                while rows := [_row(name, *item) for item in islice(items, 256)]:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)

    def _row(name: str, kind: str, offset: int, length: int, headers: dict[str, str], block: bytes, reason: str) -> tuple:
        if kind == "gap":
            return (kind, name, offset, length, *[None] * 9, reason)
        record_type = headers.get("warc-type")
        http, payload = {}, block
        if headers.get("content-type", "").startswith("application/http"):
            top, _, payload = block.partition(END_MARK)
            http = dict(line.lower().split(": ", 1) for line in top.decode("latin-1").split("\r\n")[1:] if ": " in line)
        if record_type == "revisit":
            stated = http.get("content-length", "")
            digest, size = headers.get("warc-payload-digest", "").removeprefix("sha1:"), int(stated) if re.fullmatch("[0-9]{1,18}", stated) else 0
        else:
            digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
        return (
            kind, name, offset, length, headers.get("warc-record-id"), _page(headers.get("warc-record-id")), record_type, headers.get("warc-target-uri"),
            digest, size, headers.get("warc-refers-to"), _page(headers.get("warc-refers-to")), payload if keep_payload else None, None,
        )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, ROWS)


_NAMES = [f.split()[0] for f in ROWS.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]] for f in ROWS.split(", ")]


def round_trip(df: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Write the archives of all pages in the shared folder and read their records back."""
    path = shared_path(df.sparkSession, "archives")
    write_archives(df, path)
    return read_archives(df.sparkSession, path, keep_payload)


def damaged(archive: bytes) -> bytes:
    """An archive with known damage: the version lines of pages whose ids end in 3 are overwritten, and the block lengths
    of those whose ids end in 7 are wrong."""
    archive = re.sub(rb"WARC/1\.1(\r\nWARC-Type: \w+\r\nWARC-Record-ID: <urn:page:[0-9]*3>)", rb"\0\0\0\0/1.1\1", archive)
    return re.sub(rb"(WARC-Record-ID: <urn:page:[0-9]*7>\r\n(?:[^\r\n]+\r\n)*?Content-Length: )", rb"\g<1>9", archive)
