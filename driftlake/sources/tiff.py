"""TIFF stacks: a reader (plain, Deflate, LZW and PackBits; ImageJ and OME axes) and a writer, and a folder scan that isolates
files which can't be read."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KINDS = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4", (16, 2): "i2", (32, 1): "u4"}
PLANE = "path string, frame int, c int, z int, sha256 string, height int, width int, dtype string, pixels array<float>, status string, message string"


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += data[i + 1 : i + 2] * (257 - n) if n > 128 else b""
            i += 2 if n > 128 else 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the first bit first; a width ends one code before it is full."""
    out, held, n, width, last = bytearray(), 0, 0, 9, b""
    words = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & (1 << n) - 1
        if code == 257:
            break
        if code == 256:
            del words[258:]
            width, last = 9, b""
            continue
        if code > len(words) or code == len(words) and not last:
            raise ValueError("the packed strip is damaged")
        word = words[code] if code < len(words) else last + last[:1]
        if last:
            words.append(last + word[:1])
        out += word
        last = word
        if len(words) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def read(data: bytes) -> tuple[list[np.ndarray], str]:
    """(all pages of a classic TIFF file, the description of the first)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at, pages, said, seen = struct.unpack(order + "I", data[4:8])[0], [], "", set()
    while at:
        if at in seen:
            raise ValueError("the pages form a loop")
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            size = {1: 1, 2: 1, 3: 2, 4: 4}.get(kind, 8) * count
            where = at + 10 + 12 * i
            if size > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            if kind in (1, 3, 4):
                tags[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, where)
            elif tag == 270 and not pages:
                said = data[where : where + count].rstrip(b"\0").decode("utf-8", "replace")
        packed = tags.get(259, (1,))[0]
        if packed not in _UNPACK or tags.get(277, (1,))[0] != 1 or tags.get(317, (1,))[0] not in (1, 2):
            raise ValueError(f"compression {packed} or multi-sample pages are not read")
        kind, (w,), (h,) = _KINDS[tags[258][0], tags.get(339, (1,))[0]], tags[256], tags[257]
        body = b"".join(_UNPACK[packed](data[o : o + c]) for o, c in zip(tags[273], tags[279], strict=True))
        page = np.frombuffer(body, order + kind).reshape(h, w)
        if tags.get(317, (1,))[0] == 2:  # differences along rows
            page = np.cumsum(page, axis=1, dtype=page.dtype)
        pages.append(page)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    return pages, said


def decode(data: bytes) -> list[np.ndarray]:
    """All pages of a classic TIFF file."""
    return read(data)[0]


def axes(said: str, pages: int) -> list[tuple[int, int, int]]:
    """(frame, channel, slice) of each page, from an ImageJ or OME description; without one, pages are frames.

    A file with several series is refused: which of them is the recording can't be told.
    """
    if said.count("<Image ") > 1:
        raise ValueError("more than one image series")
    if "<Pixels" in said:
        number = lambda k: int(m[1]) if (m := re.search(rf'\bSize{k}="(\d+)"', said)) else 1
        sizes = {k: number(k) for k in "CZT"}
        order = m[1] if (m := re.search(r'DimensionOrder="XY([CZT]{3})"', said)) else "CZT"
    else:
        number = lambda k: int(m[1]) if (m := re.search(rf"^{k}=(\d+)\s*$", said, re.MULTILINE)) else 1
        sizes, order = {"C": number("channels"), "Z": number("slices"), "T": number("frames")}, "CZT"
    if sizes["C"] * sizes["Z"] * sizes["T"] != pages:
        if sizes["C"] * sizes["Z"] * sizes["T"] != 1:
            raise ValueError(f"{pages} pages do not fill {sizes}")
        sizes["T"] = pages
    out = []
    for i in range(pages):
        at = {}
        for k in order:
            i, at[k] = divmod(i, sizes[k])
        out.append((at["T"], at["C"], at["Z"]))
    return out


def encode(pages: list[np.ndarray]) -> bytes:
    """A classic little-endian TIFF file with one strip a page."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for p in pages:
        p = np.ascontiguousarray(p)
        kind = next(k for k, v in _KINDS.items() if np.dtype(v) == p.dtype)
        at = len(out)
        out += p.astype(p.dtype.newbyteorder("<")).tobytes()
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        tags = [(256, 4, p.shape[1]), (257, 4, p.shape[0]), (258, 3, kind[0]), (259, 3, 1), (262, 3, 1), (273, 4, at), (277, 3, 1), (278, 4, p.shape[0]), (279, 4, p.nbytes), (339, 3, kind[1])]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def scan(spark: SparkSession, folder: str, recursive: bool = False, besides: str | None = None) -> DataFrame:
    """One row a plane of all .tif and .tiff files but earlier results, unfinished files and what lies under `besides` (the
    folder of results); a file that can't be read is a row with its error. sha256 is that of the plane's own bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").option("recursiveFileLookup", recursive).load(folder)
    files = files.where(~F.lower("path").rlike(r"_registered\.tiff?$|\.part\.tif$")).select("path", "content")
    if besides is not None:
        files = files.where(~F.col("path").contains(besides.rstrip("/") + "/"))

    def run(batches):
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages, said = read(data)
                    rows = [(path, *at, hashlib.sha256(p.tobytes()).hexdigest(), *p.shape, p.dtype.name, p.astype(np.float32).ravel(), "ok", None) for at, p in zip(axes(said, len(pages)), pages, strict=True)]
                except Exception as e:  # one bad file is a row, not the end of the batch
                    rows = [(path, *[None] * 8, "error", f"{type(e).__name__}: {e}"[:300])]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in PLANE.split(", ")])

    return files.mapInPandas(run, PLANE)


def write(planes: DataFrame, folder: str, suffix: str = "_registered") -> DataFrame:
    """A TIFF file for each recording (path, frame, height, width, dtype, pixels), named by its stem; (path, out, frames)."""
    from driftlake.sources.store import put

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        pages = []
        for r in pdf.itertuples():
            a = np.asarray(r.pixels, np.float32).reshape(r.height, r.width)
            kind = np.dtype(r.dtype)
            if kind.kind in "ui":
                a = np.clip(np.floor(a + 0.5), np.iinfo(kind).min, np.iinfo(kind).max)
            pages.append(a.astype(kind))
        stem = pdf["path"].iloc[0].rsplit("/", 1)[-1].rsplit(".", 1)[0]
        out = put(f"{folder}/{stem}{suffix}.tif", encode(pages))
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "out": [out], "frames": [len(pages)]})

    return planes.groupBy("path").applyInPandas(run, "path string, out string, frames int")
