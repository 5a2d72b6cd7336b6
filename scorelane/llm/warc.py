"""WARC archives: writing, reading back, and reassembly of segmented records.

Writing: a page is a record, and pages of one payload are revisits of one
response. A response's block is an HTTP answer with a chunked body; a block over
``segment`` bytes is cut into a first record and continuations. Spark's text sink
writes the records, with the empty lines that end a record as its line separator.

Reading: each file is a row, and a task goes through it record by record. Whole
responses are decoded there, and stay there. Segments alone are grouped by their
origin record and put in order by number; numbers without a gap and the total length
are verified, then the chunked framing is taken off and the payload held against its
digest. A group is one page's segments, so it is never larger than a page. Files may
be plain, one gzip stream, or a gzip member per record.

Defined results: a null html is an empty payload; pages with the largest id of
their payload are responses, also if that id repeats; a null ``page_id`` is below
all others; a null url is empty; repeated rows are records of their own; texts of any
length are cut into segments; an empty table gives an archive without records.
A record that is damaged has ``intact`` false and a null payload: one that is cut off,
that is not as long as it says, or that lacks what a header must have. Reading goes on
at the next record that begins a line, in a damaged gzip stream at the next member.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.llm.common import HOT_PART, staged, struct_of
from scorelane.session import work_path

CHUNK = 8192
SEGMENT = 16_384
#: Records of a file at most; with segments this bounds what a reader's task holds.
FILE_RECORDS = 2048
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "origin string, number int, total bigint, kind string, page_id bigint, url string, refers_to bigint, "
    "payload_bytes bigint, payload_digest string, intact boolean, block binary"
)
PAGES = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, intact boolean, payload binary"
)


def digest(payload: Column) -> Column:
    """The bare base32 SHA-1 of a text: 5-bit groups of its hex form."""
    found = F.sha1(payload)
    groups = [
        F.lpad(F.conv(F.substring(found, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(
        F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def _pieces(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in pieces of at most ``size`` bytes that end between characters; a character is not cut."""
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end > start and end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == start:
            end += 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        yield data[start:end]
        start = end


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    framed = [b"%x\r\n%b\r\n" % (len(piece), piece) for piece in _pieces(payload, size)]
    return b"".join(framed) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are left out."""
    found, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(found)
        start = end + 2
        if body[start + size : start + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where it says")
        found.append(body[start : start + size])
        at = start + size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP answer."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("an answer without an end of its header")
    fields = _fields(head.split(b"\r\n")[1:])
    if fields.get("transfer-encoding", "").lower() == "chunked":
        return unchunked(body)
    if "content-length" in fields and len(body) != int(fields["content-length"]):
        raise ValueError("an answer that is not as long as it says")
    return body


def _fields(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, _, value = line.partition(b":")
        found[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return found


def _sha(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, name: str, block: bytes, **fields: object) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    for key, value in fields.items():
        lines.append(f"WARC-{key.replace('_', '-').title().replace('Uri', 'URI').replace('Id', 'ID')}: {value}")
    http = "application/http;msgtype=response"
    lines += [f"Content-Type: {http}"] * (kind != "continuation") + [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines) + block.decode()


def page_records(
    name: str, url: str, payload: bytes, sha: str, refers_to: str | None, segment: int, chunk: int
) -> Iterator[str]:
    """The records of a page, as texts without the empty lines at their end."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    common = {"target_uri": url, "payload_digest": f"sha1:{sha}"}
    if refers_to is not None:
        block = f"{head}Content-Length: {len(payload)}\r\n\r\n".encode()
        yield _record("revisit", name, block, **common, profile=PROFILE, refers_to=refers_to)
        return
    block = f"{head}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload, chunk)
    if len(block) <= segment:
        yield _record("response", name, block, **common)
        return
    parts = list(_pieces(block, segment))
    yield _record("response", name, parts[0], **common, segment_number=1)
    for number, part in enumerate(parts[1:], 2):
        fields = {"segment_origin_id": name, "segment_number": number}
        if number == len(parts):
            fields["segment_total_length"] = len(block)
        yield _record("continuation", f"{name[:-1]}/{number}>", part, **fields)


def responses(pages: DataFrame, least: int = 0) -> DataFrame:
    """Payload digests that several pages have, with the page that is their response."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    return staged(
        pages.where(F.octet_length(payload) >= least)
        .groupBy(digest(payload).alias("sha"))
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("pages"))
        .where("pages > 1 AND keeper IS NOT NULL"),
        "responses",
    )


def _with_keeper(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the page that keeps their payload, if several have it.

    Payloads of over a thousandth of the pages that share one are at most a thousand and
    are broadcast, so their pages stay; the others meet their keeper by digest.
    """
    total = groups.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("n")).first()["n"]
    hot = F.col("pages") > max(1, total // HOT_PART)
    large = F.broadcast(groups.where(hot).select("sha", "keeper"))
    others = rows.join(F.broadcast(groups.where(hot).select("sha")), "sha", "left_anti")
    rest = others.join(groups.where(~hot).select("sha", "keeper"), "sha", "left")
    return rows.join(large, "sha").unionByName(rest)


def write_archive(
    pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, chunk: int = CHUNK,
    records: int = FILE_RECORDS,
) -> None:
    """Write a page per row (``page_id``, ``url``, ``html``) to compressed WARC files in ``path``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"))
    kept = F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper"))
    rows = _with_keeper(rows.withColumn("sha", digest(F.col("html"))), responses(pages, least))
    rows = rows.select("page_id", "url", "html", "sha", F.when(kept, F.col("keeper")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            found: list[str] = []
            for page, url, html, sha, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"<urn:x-page:{page}#{task}-{count}>"
                link = quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")
                target = None if refers is None else f"<urn:x-page:{refers}>"
                found.extend(page_records(name, link, html.encode(), sha, target, segment, chunk))
                count += 1
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])

    (
        rows.mapInArrow(run, "value string")
        .write.option("lineSep", "\r\n\r\n")
        .option("maxRecordsPerFile", records)
        .option("compression", "gzip")
        .text(path)
    )


class Unpacked(io.RawIOBase):
    """The bytes of a file that is plain, gzip, or gzip members one after the other.

    In a damaged member, what came before the damage is given, and reading goes on at
    the next one.
    """

    def __init__(self, data: bytes):
        self.data, self.at, self.member, self.held = data, 0, 0, b""
        self.packed = data[:2] == b"\x1f\x8b"
        self.open = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held and self.at < len(self.data):
            self.held = self._more()
        count = min(len(buffer), len(self.held))
        buffer[:count] = self.held[:count]
        self.held = self.held[count:]
        return count

    def _more(self, size: int = 1 << 16) -> bytes:
        piece = self.data[self.at : self.at + size]
        if not self.packed:
            self.at += len(piece)
            return piece
        try:
            found = self.open.decompress(piece)
        except zlib.error:
            start = self.data.find(b"\x1f\x8b\x08", self.member + 1)
            self._next(start if start >= 0 else len(self.data))
            return b""
        self.at += len(piece)
        if self.open.eof:
            self._next(self.at - len(self.open.unused_data))
        return found

    def _next(self, start: int) -> None:
        self.at = self.member = start
        self.open = zlib.decompressobj(31)


_NEXT = re.compile(rb"(?:\r?\n)+(?=WARC/\d)")


def read_records(source: BinaryIO) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Header fields and block of each record of an uncompressed stream; no block if it is damaged."""
    back: list[bytes] = []

    def line() -> bytes:
        first, end, rest = (back.pop() if back else b"").partition(b"\n")
        if rest:
            back.append(rest)
        return first + end if end else first + source.readline()

    def block(size: int) -> bytes:
        held = b"".join(reversed(back))
        back[:] = [held[size:]] if len(held) > size else []
        return held[:size] if len(held) >= size else held + source.read(size - len(held))

    while start := line():
        if not start.startswith(b"WARC/"):
            # Empty lines end a record. Others belong to one that was longer than it said.
            continue
        lines, cut = [], False
        while (field := line()).strip():
            if cut := field.startswith(b"WARC/"):
                back.append(field)
                break
            lines.append(field)
        fields = _fields(lines)
        size = fields.get("content-length", "")
        if cut or not field or not size.isdigit():
            yield fields, None
            continue
        held = block(int(size))
        inside = _NEXT.search(held)
        if inside is None:
            yield fields, held if len(held) == int(size) else None
            continue
        # Another record seems to begin in it: it is whole if an empty line follows.
        after = line()
        if len(held) == int(size) and (not after.strip()):
            yield fields, held
            continue
        back.append(held[inside.end() :] + after)
        yield fields, None


_PAGE = re.compile(r"<urn:x-page:(-?\d+)")


def _page(name: str) -> int | None:
    found = _PAGE.match(name)
    return int(found[1]) if found else None


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdigit() else None


def parsed(fields: dict[str, str], block: bytes | None, place: str = "") -> tuple | None:
    """A row of ``RECORDS``; None for records that hold no page. ``place`` names one without a name."""
    kind, number = fields.get("warc-type", "response"), _number(fields.get("warc-segment-number"))
    name = fields.get("warc-record-id") or f"<damaged:{place}>"
    sha = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    row = (kind, _page(name), fields.get("warc-target-uri"))
    if kind == "continuation":
        total = _number(fields.get("warc-segment-total-length"))
        origin = fields.get("warc-segment-origin-id")
        if origin is None or number is None or block is None:
            # Its origin misses a number, and says so.
            return None
        return origin, number, total, None, None, None, None, None, None, None, block
    if block is None and kind in ("response", "revisit"):
        refers = _page(fields.get("warc-refers-to", ""))
        return name, 1, None, *row, refers, None, sha, False, None
    if kind == "revisit":
        held = _number(_fields(block.split(b"\r\n")).get("content-length"))
        refers = _page(fields.get("warc-refers-to", ""))
        return name, 1, None, *row, refers, held, sha, held is not None, None
    if kind != "response":
        return None
    if number:
        return name, number, None, *row, None, None, sha, None, block
    payload, size, found, intact = _verified(block, sha)
    return name, 1, None, *row, None, size, found, intact, payload


def _verified(block: bytes, sha: str | None) -> tuple:
    try:
        payload = payload_of(block)
    except ValueError:
        return None, None, sha, False
    found = _sha(payload)
    return payload, len(payload), found, sha in (None, found)


def reassembled(segments: list[dict], total: int | None, sha: str | None) -> tuple:
    """Payload, its size and digest, and whether all of it is there, from ordered segments."""
    numbers = [s["number"] for s in segments]
    block = b"".join(s["block"] for s in segments)
    if numbers != list(range(1, len(numbers) + 1)) or total != len(block):
        return None, None, sha, False
    return _verified(block, sha)


def read_archive(spark: SparkSession, path: str, payloads: bool = True, files: str = "*") -> DataFrame:
    """A row per page of the WARC files in ``path``; ``payloads`` false leaves their bytes out.

    ``files`` is a pattern of the names that are read; hidden files, and such as begin with
    an underscore, are not.
    """
    held = spark.read.format("binaryFile").option("pathGlobFilter", files).load(path)
    schema, result = struct_of(RECORDS), struct_of(PAGES)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        kinds += [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                source = io.BufferedReader(Unpacked(content.as_py()), 1 << 16)
                found = []
                for count, (fields, block) in enumerate(read_records(source)):
                    if (row := parsed(fields, block, f"{file}#{count}")) is not None:
                        whole = row[9] is not None
                        found.append((*row[:10], None) if whole and not payloads else row)
                if found:
                    columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                payload, size, sha, intact = reassembled(row["parts"], row["total"], row["payload_digest"])
                held = payload if payloads else None
                kind = row["kind"] or "response"
                found.append((row["page_id"], row["url"], kind, row["refers_to"], size, sha, intact, held))
            if found:
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=result.names)

    records = staged(held.select("path", "content").mapInArrow(parse, schema), "warc-records")
    segments = records.where("intact IS NULL")
    once = ["total", "kind", "page_id", "url", "refers_to", "payload_digest"]
    grouped = segments.groupBy("origin").agg(
        *(F.max(c).alias(c) for c in once), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts")
    )
    whole = records.where("intact IS NOT NULL").select(
        "page_id", "url", F.col("kind").alias("record_type"), "refers_to", "payload_bytes", "payload_digest", "intact",
        F.col("block").alias("payload"),
    )
    return whole.unionByName(grouped.drop("origin").mapInArrow(join, result))


def round_trip(pages: DataFrame, least: int = 0, path: str | None = None, payloads: bool = True) -> DataFrame:
    """Write ``pages`` to an archive and read its pages back."""
    path = path or work_path(pages.sparkSession, "warc")
    write_archive(pages, path, least)
    return read_archive(pages.sparkSession, path, payloads)


