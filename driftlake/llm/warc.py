"""WARC archives in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with whole WARC records, and a seek table in a skippable
frame at its end (the published seekable format: compressed and plain size of each frame, then a 9-byte footer).
Any Zstandard tool unpacks a bundle to a plain WARC file; with the footer, one frame can be read alone. The index
maps a record to its bundle, frame and offset within the frame.

A record whose payload another record has is a revisit of it: of equal payloads of at least `least` bytes the record
with the largest id is the response.

Defined results: a null payload is empty; a null id never is the one that others revisit, unless all ids of its
payload are null: these are responses; repeated rows get a record each, and all rows with the largest id of a payload
are responses; CR and LF in a URL are percent-encoded; an empty table gives no bundles; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import materialise, new_path, shuffle_partitions, table
from driftlake.llm.files import Out, open_in

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Parts that the rows of a payload which occurs more than once are dealt to.
SALTS = 32
#: Plain bytes after which a frame ends, and packed bytes after which a bundle does.
FRAME, BUNDLE = 1 << 18, 1 << 26
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:driftlake:page:"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = "page_id string, bundle string, frame int, at long, size long"
RECORD = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: str | None) -> str:
    return "null" if page_id is None else page_id.replace("%", "%25").replace(">", "%3E").replace("\r", "%0D").replace("\n", "%0A")


def _id(name: str) -> str | None:
    return None if name == "null" else name.replace("%0A", "\n").replace("%0D", "\r").replace("%3E", ">").replace("%25", "%")


def record(page_id: str | None, url: str | None, payload: bytes, head: str | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit of `head` where head is not None."""
    block = HTTP if head is not None else HTTP + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if head is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{_name(page_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if head is not None:
        lines[2:2] = [f"WARC-Refers-To: <{URN}{_name(head)}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Packs records into frames and bundles under a folder; yields index rows as bundles end."""

    def __init__(self, folder: str, stem: str):
        self.folder, self.stem = folder, stem
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.out = None
        self.frame: list[bytes] = []
        self.plain, self.sizes, self.rows = 0, [], []

    def add(self, page_id: str | None, data: bytes) -> list[tuple]:
        if self.out is None:
            self.out = Out(self.folder, self.stem, ".warc.zst")
        self.rows.append((page_id, len(self.sizes), self.plain, len(data)))
        self.frame.append(data)
        self.plain += len(data)
        if self.plain >= FRAME:
            self._end_frame()
        return self.end() if self.out.size >= BUNDLE else []

    def _end_frame(self) -> None:
        if self.frame:
            packed = self.packer.compress(b"".join(self.frame))
            self.out.write(packed)
            self.sizes.append((len(packed), self.plain))
            self.frame, self.plain = [], 0

    def end(self) -> list[tuple]:
        if self.out is None:
            return []
        self._end_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE))
        uri = self.out.close()
        rows = [(p, uri, f, at, n) for p, f, at, n in self.rows]
        self.out, self.sizes, self.rows = None, [], []
        return rows


class Bundle:
    """Reads a bundle by its seek table."""

    def __init__(self, uri: str):
        self.f = open_in(uri)
        end = self.f.seek(0, 2)
        self.f.seek(end - 9)
        n, kind, magic = struct.unpack("<IBI", self.f.read(9))
        if magic != SEEKABLE or kind & 0x80:
            raise ValueError(f"{uri}: no seek table")
        self.f.seek(end - 9 - 8 * n - 8)
        if struct.unpack("<II", self.f.read(8)) != (SKIPPABLE, 8 * n + 9):
            raise ValueError(f"{uri}: the seek table is damaged")
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", self.f.read(8 * n)):
            self.frames.append((at, packed, plain))
            at += packed
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        self.f.seek(at)
        return self.unpacker.decompress(self.f.read(packed), max_output_size=plain)

    def record(self, frame: int, at: int, size: int) -> tuple:
        return parse(self.frame(frame)[at : at + size])[0]

    def records(self) -> Iterator[tuple]:
        for i in range(len(self.frames)):
            data, at = self.frame(i), 0
            while at < len(data):
                row, at = parse(data, at)
                yield row


def parse(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """(a RECORD row, the offset behind the record); the payload of a response is held against its digest."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    h = dict(x.split(": ", 1) for x in lines)
    start = end + 4
    stop = start + int(h["Content-Length"])
    block = data[start:stop]
    name = lambda x: _id(re.fullmatch(f"<{URN}(.*)>", x, re.DOTALL)[1])
    kind, said = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = block[block.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
    if payload is not None and (digest(payload) != said or len(payload) != int(h["X-Payload-Length"])):
        raise ValueError(f"{h['WARC-Record-ID']}: the payload does not match its digest")
    refers = name(h["WARC-Refers-To"]) if kind == "revisit" else None
    return (name(h["WARC-Record-ID"]), int(h["X-Payload-Length"]), said, kind, refers, h["WARC-Target-URI"], payload), stop + 4


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the bundles and returns their index (INDEX), kept in a table so that no bundle is written twice."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("body"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("body")))
    # only payloads that occur again need a head: these few rows go to all parts of their payload's rows
    heads = rows.groupBy("sha").agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    heads = heads.select("sha", "head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    both = salted.join(heads, ["sha", "salt"], "left").withColumn("again", (F.length("body") >= least) & F.col("head").isNotNull() & ~F.col("id").eqNullSafe(F.col("head")))
    both = both.select(F.col("id").cast("string"), "url", "body", F.when(F.col("again"), F.col("head").cast("string")).alias("head"), "again")

    def run(batches):
        w = BundleWriter(folder, "bundle")
        made = lambda rows: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "bundle", "frame", "at", "size"])
        for b in batches:
            for page_id, link, body, head, again in zip(*(c for c in b.columns), strict=True):
                page_id = page_id.as_py()
                if done := w.add(page_id, record(page_id, link.as_py(), body.as_py(), head.as_py() if again.as_py() else None, date)):
                    yield made(done)
        if done := w.end():
            yield made(done)

    return materialise(both.mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame, payloads: bool = False) -> DataFrame:
    """All records (RECORD) of the bundles that an index names; payloads are null unless asked for."""

    def run(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                rows: list = []
                for r in Bundle(uri).records():
                    rows.append(r if payloads else (*r[:-1], None))
                    if len(rows) == 2000 or payloads and len(rows) == 100:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
        names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # a fixed number of tasks: left to itself, adaptive execution would merge these few names into one task
    names = index.select("bundle").repartition(shuffle_partitions(index.sparkSession), "bundle").distinct()
    return names.mapInArrow(run, RECORD)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of some ids (column page_id, string): only the frames that hold them are read."""

    def run(batches):
        for b in batches:
            for bundle, frame, at, size in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                r = Bundle(bundle).record(frame, at, size)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
                yield pa.record_batch([pa.array([x], t) for x, t in zip(r, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    return index.join(ids.select("page_id").distinct(), "page_id", "left_semi").select("bundle", "frame", "at", "size").mapInArrow(run, RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    index = write(pages, new_path(spark, "warc"))
    return read(index).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))


#: DuckDB: base32 of a SHA-1 by its hexadecimal digits, five at a time.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), h AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS head FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i + 1, 5))::BIGINT >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM h
"""
