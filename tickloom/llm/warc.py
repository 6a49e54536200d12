"""WARC derivatives: metadata and plain-text conversion records, linked to the responses that they come from.

Each record is a gzip member of its own, so a reader can start at any record. Tasks put members together up to FILE_BYTES,
and Spark's text writer makes a file of each such run (a longer record is a file by itself); the row separator that it adds
is an empty gzip member, which holds nothing. Files are read as a stream and cut by the records' own Content-Length, so no
text inside can be taken for a border; a task holds one file's compressed bytes and one record.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .site_style import visible_text

#: Bytes of a file, as it is on disk, from which on it ends.
FILE_BYTES = 16 << 20
#: Rows of an Arrow batch, and the bytes of their blocks from which on it ends.
BATCH_ROWS, BATCH_BYTES = 200, 8 << 20
#: The date of a response for which none is given: tables of pages have none, and WARC asks for one.
DATE = "2024-01-01T00:00:00Z"
#: Bytes of a gzip file that are given to zlib at once, and the most that it gives for them.
PIECE, MOST_OUT = 1 << 14, 1 << 20
RECORD = "headers map<string,string>, block binary"
#: Fixed value: the name space of record ids that are made from content.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Fixed value: a gzip member of no bytes.
EMPTY = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
#: Headers that have a place of their own in derivatives.
OWN = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Type", "Content-Length", "X-Source-Row")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    """An id made from the parts: a task that runs again names its records as before."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, repr(parts))}>"


def clean(value: object) -> str:
    """A header's value: on one line."""
    return " ".join(str(value).split())


def record(kind: str, headers: dict[str, object], block: bytes) -> tuple[dict[str, str], bytes]:
    given = {"WARC-Type": kind, **{k: clean(v) for k, v in headers.items() if v is not None}}
    return given | {"WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}, block


def batched(records: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of records, bounded by bytes."""
    out, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(h.items()) for h, _ in out], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in out], pa.binary())], names=["headers", "block"])

    for r in records:
        out.append(r)
        size += len(r[1])
        if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            out, size = [], 0
    if out:
        yield batch()


def _records(rows: DataFrame, make) -> DataFrame:
    """The records that ``make`` gives for each row's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield from batched(r for row in zip(*(c.slice(at, BATCH_ROWS).to_pylist() for c in batch.columns), strict=True) for r in make(*row))

    return rows.mapInArrow(run, RECORD)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Response records of pages, with HTTP headers. Null html is an empty body; a null url or id leaves out its header.

    Equal rows give equal records, with one id. Other columns are left behind. An empty table gives no records; pages are
    carried whole. All records have the date ``date``, in WARC's form.
    """

    def make(page: object, url: str | None, html: str | None) -> Iterator[tuple[dict[str, str], bytes]]:
        body = (html or "").encode()
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        yield record("response", {"WARC-Record-ID": record_id("response", page, url, digest(body)), "WARC-Date": date, "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(body), "X-Source-Row": page}, http + body)

    return _records(pages.select(id_col, url_col, html_col), make)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """The status line, the headers, and the body of an HTTP message; a block without a header end is all body."""
    head, end, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    if not end or not lines[0].startswith("HTTP/"):
        return "", [], block
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], body


def charset(headers: list[tuple[str, str]]) -> str:
    """The charset that the headers name, where Python knows it; else UTF-8."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    name = (re.search(r"charset=[\"']?([\w.:-]+)", kind) or ["", "utf-8"])[1]
    try:
        b"".decode(name)
    except LookupError:
        return "utf-8"
    return name


def derive(sources: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response among ``sources``; other records give none.

    Both refer to the response (WARC-Refers-To) and to each other (WARC-Concurrent-To), and carry its target, date, payload
    digest and source row. The metadata block has the status line, every source header and the source's digests as
    fields, and every other WARC header of the source as source-warc-NAME; the conversion block is the visible text in
    UTF-8. A payload that doesn't match its digest is marked so. A null block counts as empty; a response without an id
    gives records that refer to nothing; repeated responses each give their two records, with equal ids.
    """

    names = ["WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest", "X-Source-Row"]

    def make(block: bytes, more: list[tuple[str, str]], *values: str | None) -> Iterator[tuple[dict[str, str], bytes]]:
        source = {k: v for k, v in zip(names, values, strict=True) if v is not None}
        status, http, body = split_http(block or b"")
        name, found = charset(http), digest(body)
        text = visible_text(body.decode(name, "replace")).encode()
        of = source.get("WARC-Record-ID")
        ids = {kind: record_id(kind, of) for kind in ("metadata", "conversion")}
        shared = {"WARC-Date": source.get("WARC-Date"), "WARC-Target-URI": source.get("WARC-Target-URI"), "WARC-Refers-To": of, "WARC-Refers-To-Target-URI": source.get("WARC-Target-URI"), "WARC-Refers-To-Date": source.get("WARC-Date"), "X-Source-Row": source.get("X-Source-Row")}
        fields = [("source-status", status), *((f"source-header-{k}", v) for k, v in http), *((f"source-warc-{k}", v) for k, v in more), ("source-charset", name), ("source-payload-digest", source.get("WARC-Payload-Digest", found)), ("source-block-digest", source.get("WARC-Block-Digest", "")), ("source-payload-matches", str(source.get("WARC-Payload-Digest", found) == found).lower()), ("conversion-block-digest", digest(text))]
        yield record("metadata", {"WARC-Record-ID": ids["metadata"], **shared, "WARC-Concurrent-To": ids["conversion"], "Content-Type": "application/warc-fields"}, "".join(f"{clean(k)}: {clean(v)}\r\n" for k, v in fields).encode())
        yield record("conversion", {"WARC-Record-ID": ids["conversion"], **shared, "WARC-Concurrent-To": ids["metadata"], "Content-Type": "text/plain; charset=utf-8", "WARC-Source-Payload-Digest": source.get("WARC-Payload-Digest", found)}, text)

    of_pages = sources.where(F.col("headers")["WARC-Type"] == "response")
    more = F.map_filter("headers", lambda k, _: ~k.isin(*OWN))
    return _records(of_pages.select("block", more.alias("more"), *(F.col("headers")[n].alias(n) for n in names)), make)


def member(head: bytes, block: bytes, level: int = 1) -> bytes:
    """A record, of its headers as they are written and its block, in a gzip member."""
    return zlib.compress(b"".join((head, block, b"\r\n\r\n")), level, wbits=31)


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes records (headers, block) as gzipped WARC/1.0 files of about ``file_bytes`` bytes, or a longer record's size.

    Blocks are any bytes; a null block counts as empty, null headers as none. Repeated records are written as often as they
    come, an empty table gives no records; other columns are left behind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                for head, block in zip(*(c.slice(at, BATCH_ROWS).to_pylist() for c in batch.columns), strict=True):
                    held.append(member(head, block))
                    size += len(held[-1])
                    if size >= file_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])

    lines = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n"))), "")
    rows = records.select(F.encode(F.concat(F.lit("WARC/1.0\r\n"), F.coalesce(lines, F.lit("")), F.lit("\r\n")), "UTF-8").alias("head"), F.coalesce("block", F.lit(b"")).alias("block"))
    # a cast keeps the bytes as they are
    files = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


class Inflated(io.RawIOBase):
    """A file of gzip members as one stream, a piece at a time; zeros may follow a member. Zlib takes what is most of a member, or
    all, in one call, and checks its sum."""

    def __init__(self, data: bytes):
        self.data, self.at, self.member, self.ready = memoryview(data), 0, None, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, into: memoryview) -> int:
        while not self.ready:
            if self.member is None:
                while self.at < len(self.data) and not self.data[self.at]:
                    self.at += 1
                if self.at == len(self.data):
                    return 0
                self.member = zlib.decompressobj(31)
            given = self.data[self.at : self.at + PIECE]
            out = self.member.decompress(given, MOST_OUT)
            self.at += len(given) - len(self.member.unused_data if self.member.eof else self.member.unconsumed_tail)
            if self.member.eof:
                self.member = None
            elif not given and not out:
                raise EOFError("a gzip member is cut off")
            self.ready = memoryview(out)
        n = min(len(into), len(self.ready))
        into[:n] = self.ready[:n]
        self.ready = self.ready[n:]
        return n


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file, one at a time; gzip is told by its first bytes, whether the file or each record is a member."""
    stream = Inflated(data) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    with io.BufferedReader(stream, 1 << 16) as lines:
        while line := lines.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {line[:40]!r}")
            headers = {}
            while (line := lines.readline()) not in (b"\r\n", b"\n"):
                if not line:
                    raise ValueError("a record's headers are cut off")
                k, _, v = line.decode("utf-8", "replace").partition(":")
                headers[k.strip()] = v.strip()
            size = int(headers["Content-Length"])
            block = lines.read(size)
            if len(block) < size:
                raise ValueError("a record is cut off")
            yield headers, block
            lines.read(4)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files in a folder: headers (map) and block (binary); of an empty folder none.

    Repeated records come as often as they are there. A file's bytes on disk have to fit into a row (2 GB), and a record
    into a worker's memory.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from batched(parse_warc(content.as_py()))

    return files.mapInArrow(run, RECORD)
