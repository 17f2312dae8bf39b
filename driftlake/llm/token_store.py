"""Token ids in binary shards whose document boundaries are Elias-Fano encoded.

A shard holds the ids of its documents one after the other, two bytes each where all ids fit (else four), then the
documents' ids and the boundaries, both as Elias-Fano sequences, then a footer of fixed size. An Elias-Fano sequence
of n values up to u takes about n * (2 + log2(u / n)) bits: the low bits of each value packed, the high bits in unary,
and 32-bit samples of every 256th one's place by which select finds any value without scanning.

Shards are written in ascending order of document id: rows are dealt by ranges of (id, hash of the text), so that not
even one id that a third of the rows share lands in one task. A writer holds boundaries, never a shard's ids.

Defined results: a null text is empty (the end id alone); null ids come first; rows with equal ids are ordered by
(hash of the text, text); an empty table gives no shards; other columns are not read. Ids are integers.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlake.llm.bpe import Cache, byte_chars, default_vocabulary
from driftlake.llm.common import materialise, new_path, shuffle_partitions, table
from driftlake.llm.files import Out, open_in

MAGIC = b"DLTOKEN1"
FOOTER = struct.Struct("<QQQqQQII8s")  # n ids, n documents, n null ids, least id, bytes of ids, of document ids, id width, 0, magic
SAMPLE = 256
#: Ids after which a shard ends.
SHARD = 1 << 26
MANIFEST = "part int, shard int, uri string, n_docs long, n_ids long"


class EliasFano:
    """A non-decreasing sequence of non-negative integers below 2^64, with select by place."""

    HEAD = struct.Struct("<QBQQ")  # n, low bits, words of low bits, words of high bits

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        top = int(v[-1])
        low_bits = max(0, (top // n).bit_length() - 1)
        place = (v >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(place[-1]) // 64 + 1, np.uint64)
        np.bitwise_or.at(high, (place // np.uint64(64)).astype(np.int64), np.uint64(1) << (place % np.uint64(64)))
        low = np.zeros((n * low_bits + 63) // 64 + 1, np.uint64)
        if low_bits:
            part = v & np.uint64((1 << low_bits) - 1)
            bit = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            word, shift = (bit // np.uint64(64)).astype(np.int64), bit % np.uint64(64)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(low_bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        if int(place[-1]) >> 32:
            raise ValueError("a shard's sequence is too long for 32-bit samples")
        return cls(n, low_bits, low, high, place[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        word, shift = divmod(i * self.low_bits, 64)
        out = int(self.low[word]) >> shift
        if shift + self.low_bits > 64:
            out |= int(self.low[word + 1]) << (64 - shift)
        return out & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value i: the place of the i-th one from the sample before it, at most SAMPLE ones further."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        word = place // 64
        bits = int(self.high[word]) >> (place % 64) << (place % 64)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = word * 64 + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def __iter__(self) -> Iterator[int]:
        return (self.select(i) for i in range(self.n))

    def values(self) -> np.ndarray:
        """All values at once."""
        place = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")).astype(np.uint64)
        i = np.arange(self.n, dtype=np.uint64)
        out = (place - i) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = i * np.uint64(self.low_bits)
            word, shift = (bit // np.uint64(64)).astype(np.int64), bit % np.uint64(64)
            low = self.low[word] >> shift
            over = shift + np.uint64(self.low_bits) > 64
            low[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
            out |= low & np.uint64((1 << self.low_bits) - 1)
        return out

    def pack(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.low.astype("<u8").tobytes() + self.high.astype("<u8").tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def unpack(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        low, high = np.frombuffer(data, "<u8", a, at), np.frombuffer(data, "<u8", b, at + 8 * a)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", -(-n // SAMPLE), at + 8 * (a + b)))


class ShardWriter:
    def __init__(self, folder: str, width: int):
        self.out = Out(folder, "tokens", ".bin")
        self.kind = {2: "<u2", 4: "<u4"}[width]
        self.width, self.n_ids, self.ends, self.docs, self.nulls = width, 0, [0], [], 0

    def add(self, doc_id: int | None, ids: bytes, end_id: int) -> None:
        """ids: little-endian uint32."""
        a = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
        self.out.write(a.astype(self.kind).tobytes())
        self.n_ids += len(a)
        self.ends.append(self.n_ids)
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(doc_id)

    def close(self) -> tuple[str, int, int]:
        least = self.docs[0] if self.docs else 0
        docs = EliasFano.build(np.array([d - least for d in self.docs], np.uint64)).pack()
        ends = EliasFano.build(np.array(self.ends, np.uint64)).pack()
        n = len(self.docs) + self.nulls
        self.out.write(docs + ends + FOOTER.pack(self.n_ids, n, self.nulls, least, self.n_ids * self.width, len(docs), self.width, 0, MAGIC))
        return self.out.close(), n, self.n_ids


class Shard:
    """Reads any document of a shard by its place."""

    def __init__(self, uri: str):
        self.f = open_in(uri)
        size = self.f.seek(0, 2)
        self.f.seek(size - FOOTER.size)
        self.n_ids, self.n_docs, self.nulls, self.least, self.body, docs, self.width, _, magic = FOOTER.unpack(self.f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token shard")
        self.f.seek(self.body)
        data = self.f.read(size - FOOTER.size - self.body)
        self.docs, self.ends = EliasFano.unpack(data[:docs]), EliasFano.unpack(data[docs:])
        self.kind = {2: "<u2", 4: "<u4"}[self.width]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.docs.select(i - self.nulls) + self.least

    def span(self, i: int) -> tuple[int, int]:
        return self.ends.select(i), self.ends.select(i + 1)

    def ids(self, start: int, end: int) -> np.ndarray:
        self.f.seek(start * self.width)
        return np.frombuffer(self.f.read((end - start) * self.width), self.kind).astype("<u4")


class LibraryEncoder:
    """The tokenizers library behind bounded caches of parts of text that no token crosses.

    A text is cut before each space that stands between two characters that are not white space; texts with other
    white space beside a space go to the library whole. A part not seen before is cut further where letters begin or
    end, which no token crosses but for contractions: a run of letters is one word for the library's model, and
    everything else goes to the library as it is.
    """

    _RUNS = regex.compile(r" ?\p{L}+|\P{L}+")
    _TWO = re.compile(r"\s\s")

    def __init__(self, path: str, size: int = 1 << 19):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.model = self.lib.model
        self.most = self.lib.get_vocab_size()
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.chars = {b: c for c, b in byte_chars().items()}
        self.size, self.seen, self.old = size, {}, {}
        self.runs = Cache(self._run, size)
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(65)]
        self.space = self.chars[32]

    def _library(self, text: str) -> bytes:
        ids = self.lib.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _run(self, run: str) -> bytes:
        if not run[-1].isalpha():
            return self._library(run)
        return self._word(run.encode().decode("latin-1").translate(self.chars))

    def _word(self, chars: str) -> bytes:
        """Tokens of a run of letters, given as the characters that stand for its bytes."""
        ids = [t.id for t in self.model.tokenize(chars)]
        return self.packs[len(ids)](*ids) if len(ids) < 65 else struct.pack(f"<{len(ids)}I", *ids)

    def _part(self, part: str) -> bytes:
        if part[1:].isalpha() and (part[0] == " " or part[0].isalpha()):
            return self.runs[part]
        if part[-1:] in (".", ",") and part[1:-1].isalpha() and (part[0] == " " or part[0].isalpha()):
            return self.runs[part[:-1]] + self.runs[part[-1]]
        if "'" in part or self._TWO.search(part) or any(s in part for s in self.special):
            return self._library(part)
        return b"".join(map(self.runs.__getitem__, self._RUNS.findall(part)))

    def encode(self, text: str) -> bytes:
        seen = self.seen
        first, *parts = text.split(" ")
        new = set(parts).difference(seen)
        if not first or first[-1].isspace() or any(not p or p[0].isspace() or p[-1].isspace() for p in new if not p.isalpha()):
            return self._library(text)
        if len(seen) + len(new) > self.size:
            self.old, seen = seen, {p: seen[p] for p in parts if p in seen}
            self.seen = seen
        long = [p for p in new if len(p) >= 256]
        old, word, part, space = self.old, self._word, self._part, self.space
        for p in new:
            ids = old.get(p)
            if ids is None:  # ASCII letters stand for themselves
                if p.isascii():
                    if p.isalpha():
                        ids = word(space + p)
                    elif p[-1] in ".," and p[:-1].isalpha():
                        ids = (seen.get(p[:-1]) or old.get(p[:-1]) or word(space + p[:-1])) + self.runs[p[-1]]
                    else:
                        ids = part(" " + p)
                else:
                    ids = part(" " + p)
            seen[p] = ids
        out = self._part(first) + b"".join(map(seen.__getitem__, parts))
        for p in long:
            del seen[p]
        return out


_made: dict = {}


def library_encoder(path: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _made:
        _made[path] = LibraryEncoder(path)
    return _made[path]


def write(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards and returns their manifest, kept in a table so that no shard is written twice.

    The manifest has `base`, the number of ids in all shards before.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = ["id", F.xxhash64("text")]
    rows = src.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "text")

    def run(batches):
        from pyspark import TaskContext

        from driftlake.llm import token_store as ts

        encoder, made, w = ts.library_encoder(path), [], None
        width = 2 if max(encoder.most, end_id) < 1 << 16 else 4
        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = w or ts.ShardWriter(folder, width)
                w.add(doc_id, encoder.encode(t.as_py()), end_id)
                if w.n_ids >= ts.SHARD:
                    made.append(w.close())
                    w = None
        if w:
            made.append(w.close())
        if made:
            task = TaskContext.get().partitionId()
            cols = zip(*((task, i, *m) for i, m in enumerate(made)), strict=True)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "shard", "uri", "n_docs", "n_ids"])

    shards = materialise(rows.mapInArrow(run, MANIFEST), "token-manifest")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(manifest: DataFrame, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shards; with its ids if asked for."""

    def run(batches):
        from driftlake.llm import token_store as ts

        for b in batches:
            for uri, base in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                s = ts.Shard(uri)
                for at in range(0, s.n_docs, 500):
                    rows = []
                    for i in range(at, min(s.n_docs, at + 500)):
                        start, end = s.span(i)
                        a = s.ids(start, end)
                        rows.append((s.doc_id(i), base + start, end - start, zlib.crc32(a.tobytes()), a.view(np.int32) if ids else None))
                    cols = list(zip(*rows, strict=True))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][: 5 if ids else 4], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if ids else 4])

    shards = manifest.select("uri", "base").repartition(shuffle_partitions(manifest.sparkSession), "uri")
    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read(write(docs, new_path(spark, "tokens"), default_vocabulary(), end_id=2))
