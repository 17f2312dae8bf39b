"""Benchmark decontamination by edit distance.

A document is contaminated by an item if it holds a passage within `rate` of the item's length in edits of the whole
item. Texts are compared case-folded (Unicode) and with runs of white space as one space, as UTF-8 bytes.

1. Windows: an item (a part of `UNIT` bytes at most of a longer one) is cut in budget + 1 pieces of `SEEDS[-1]` bytes or
   more. Any passage within the budget holds one of them intact, so the places where a piece's first bytes occur, less
   the piece's offset, are all the places where an item-sized window needs to be looked at; no passage is lost here.
   Walking the windows at all places instead finds the same and takes about 70 times the time (README).
2. The CGK random walk maps a window to a string of fixed length in which edit distance becomes Hamming distance: at
   each step it writes the current byte and moves on or stays by a random bit that depends on step and byte.
3. Bit-sampling LSH: a table samples `BITS` places of the walk, and window and item are a pair if they agree on all
   places of a table. `WALKS` walks with `TABLES` tables each give the recall (measured in the tests, 0.99 and more).
4. Pairs are verified: the least edit distance of the item to any passage around the window, by a bit-parallel scan.

Items are a query set and are taken in blocks of bounded size, each sent to all tasks; documents are never collected,
shuffled or paired with one another. Walks are made for `CELLS` bytes at once, however long the items are.

Defined results: a null or empty text holds nothing; a null item or one of white space alone matches nothing; an item so
short that one edit is beyond its budget matches exactly, as a string of bytes; repeated rows get a row each; an empty
table of documents gives an empty result, one of items leaves all documents clean; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import table, trimming

#: Edits allowed as a share of an item's bytes.
RATE = 0.05
#: Bytes of a piece that are looked up: of long pieces, and of those that short items have.
SEEDS = (16, 10)
#: Bytes of an item that are walked as one, and bytes of walks made at once.
UNIT, CELLS = 4096, 1 << 23
WALKS, TABLES, BITS = 3, 12, 4
#: Items and bytes of items in a block.
BLOCK, BLOCK_BYTES = 20_000, 8 << 20
#: Bytes of text scanned at once.
CHUNK = 1 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def normalised(text: bytes) -> bytes:
    if not text.isascii():
        text = text.decode("utf-8", "surrogateescape").casefold().encode("utf-8", "surrogateescape")
    return b" ".join(text.lower().split())


def _keys(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the `seed` bytes (8 to 16) at each place."""
    x = data.astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    x = x[:-4] | (x[4:] << np.uint64(32))
    h = (x[: len(x) - seed + 8] * _ODD[0]) ^ (x[seed - 8 :] * _ODD[1])
    h = (h ^ (h >> np.uint64(29))) * _ODD[2]
    return h ^ (h >> np.uint64(32))


def edit_search(pattern: bytes, text: bytes, most: int) -> int:
    """Least edit distance of `pattern` to a substring of `text`, or most + 1 where it is larger than `most`."""
    n = len(pattern)
    if pattern in text:
        return 0
    places: dict[int, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for c in text:
        eq = places.get(c, 0)
        d0 = ((((eq & up) + up) ^ up) | eq | down) & full
        h_up, h_down = down | (full & ~(d0 | up)), up & d0
        if h_up & top:
            score += 1
        elif h_down & top:
            score -= 1
        h_up = (h_up << 1) & full
        h_down = (h_down << 1) & full
        up, down = h_down | (full & ~(d0 | h_up)), h_up & d0
        if score < best:
            best = score
            if best <= 0:
                break
    return best if best <= most else most + 1


def cgk(rows: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """The walk over rows of bytes, padded with zeros by one column at least: (rows, steps)."""
    moves = np.random.default_rng(1000 + walk).integers(0, 2, (steps, 256), np.int64)
    out = np.zeros((len(rows), steps), np.uint8)
    at, each, last = np.zeros(len(rows), np.int64), np.arange(len(rows)), rows.shape[1] - 1
    for j in range(steps):
        c = rows[each, at]
        out[:, j] = c
        at = np.minimum(at + moves[j][c], last)
    return out


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(s[:width].ljust(width + 1, b"\0") for s in strings), np.uint8).reshape(len(strings), width + 1)


class _Seeds:
    """Pieces of units by a hash of their first bytes."""

    def __init__(self, seed: int, pieces: list[tuple[bytes, int, int]]):
        self.seed = seed
        keys = np.array([int(_keys(np.frombuffer(p[:seed], np.uint8), seed)[0]) for p, _, _ in pieces], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.where = np.array([p[1:] for p in pieces], np.int64).reshape(-1, 2)[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(pieces))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys >> np.uint64(44)] = True

    def windows(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the piece, unit, first byte of the unit) for each piece that occurs in `data`."""
        key = _keys(data, self.seed)
        near = np.flatnonzero(self.filter[key >> np.uint64(44)])
        i = np.minimum(np.searchsorted(self.keys, key[near]), len(self.keys) - 1)
        hit = self.keys[i] == key[near]
        pos, i = near[hit], i[hit]
        many = self.first[i + 1] - self.first[i]
        each = np.repeat(self.first[i] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        pos = np.repeat(pos, many)
        return pos, self.where[each, 0], pos - self.where[each, 1]


class Items:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, ids: list, texts: list[bytes], rate: float = RATE):
        self.ids, self.texts = ids, texts
        self.size = np.array([len(t) for t in texts], np.int64)
        self.budget = (self.size * rate).astype(np.int64)
        self.tiny = None  # items too short for a seed, as an automaton
        units, pieces = [], {seed: [] for seed in SEEDS}
        for i, t in enumerate(texts):
            if len(t) < SEEDS[-1]:
                self.tiny = self.tiny or ahocorasick.Automaton()
                name = t.decode("latin-1")
                self.tiny.add_word(name, [*self.tiny.get(name, []), i])
                continue
            parts = -(-len(t) // UNIT)
            for u in range(parts):
                lo, hi = u * len(t) // parts, (u + 1) * len(t) // parts
                n = int((hi - lo) * rate) + 1
                for p in range(n):
                    at, end = p * (hi - lo) // n, (p + 1) * (hi - lo) // n
                    seed = next((x for x in SEEDS if end - at >= x), None)
                    if seed is None:
                        raise ValueError(f"a rate of {rate} leaves pieces of fewer than {SEEDS[-1]} bytes")
                    pieces[seed].append((t[lo + at : lo + end], len(units), at))
                units.append((i, lo, hi - lo))
        if self.tiny is not None:
            self.tiny.make_automaton()
        self.item, self.at, self.length = (np.array([u[k] for u in units], np.int64) for k in range(3))
        self.seeds = [_Seeds(seed, found) for seed, found in pieces.items() if found]
        draws = np.random.default_rng(7).random((WALKS, TABLES, BITS))
        self.sample = (draws[:, None] * (2 * self.length)[None, :, None, None]).astype(np.int32)  # walk, unit, table, bit
        self.signs = np.zeros(self.sample.shape, np.uint8)
        own = [texts[i][lo : lo + n] for i, lo, n in units]
        for part, width in self._parts(np.arange(len(units))):
            rows = _padded([own[u] for u in part.tolist()], width)
            for w in range(WALKS):
                self.signs[w, part] = cgk(rows, 2 * width, w)[np.arange(len(part))[:, None, None], self.sample[w][part]]

    def _parts(self, unit: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Places in `unit` in parts of similar length whose walks have CELLS bytes at most, and the largest length."""
        order = np.argsort(self.length[unit], kind="stable")
        lo = 0
        while lo < len(order):
            most = int(self.length[unit[order[min(lo + 4095, len(order) - 1)]]])
            part = order[lo : lo + max(1, min(4096, CELLS // (2 * most)))]
            yield part, int(self.length[unit[part[-1]]])
            lo += len(part)

    def find(self, texts: list[bytes]) -> list[list[int]]:
        """For each normalised text the items that it holds."""
        found: list[set[int]] = [set() for _ in texts]
        if self.tiny is not None:
            for f, t in zip(found, texts, strict=True):
                f.update(i for _, held in self.tiny.iter(t.decode("latin-1")) for i in held)
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        joined = b"\n".join(texts) + b"\n" * (2 * SEEDS[0])
        starts = np.cumsum(lengths) - lengths
        tried: dict[tuple[int, int], int] = {}
        for at in range(0, len(joined) - SEEDS[0], CHUNK):
            part = np.frombuffer(joined[at : at + CHUNK + SEEDS[0] - 1], np.uint8)
            if len(part) < 2 * SEEDS[0]:
                part = np.concatenate((part, np.zeros(2 * SEEDS[0], np.uint8)))
            for seeds in self.seeds:
                pos, unit, start = seeds.windows(part)
                doc = np.searchsorted(starts, pos + at, "right") - 1
                doc, unit, start = np.unique(np.stack([doc, unit, start + at]), axis=1)
                self._pairs(joined, starts, lengths, doc, unit, start, found, tried)
        return [sorted(f) for f in found]

    def _pairs(self, joined, starts, lengths, doc, unit, start, found, tried) -> None:
        begin, end = starts[doc], starts[doc] + lengths[doc] - 1
        lo, hi = np.maximum(start, begin), np.minimum(start + self.length[unit], end)
        same = np.zeros(len(doc), bool)
        for part, width in self._parts(unit):
            rows = _padded([joined[a:b] for a, b in zip(lo[part].tolist(), hi[part].tolist(), strict=True)], width)
            each, u, near = np.arange(len(part))[:, None, None], unit[part], np.zeros(len(part), bool)
            for w in range(WALKS):
                near |= (cgk(rows, 2 * width, w)[each, self.sample[w][u]] == self.signs[w][u]).all(axis=2).any(axis=1)
            same[part] = near
        item = self.item[unit]
        first = start - self.at[unit]
        kept = np.flatnonzero(same)
        kept = kept[np.lexsort((first[kept], item[kept], doc[kept]))]
        for d, i, s, b, e in zip(*(x[kept].tolist() for x in (doc, item, first, begin, end)), strict=True):
            k = int(self.budget[i])
            # windows that start within half a budget of a tried one are inside what was searched there
            if i in found[d] or 0 <= s - tried.get((d, i), 1 << 60) <= k // 2:
                continue
            tried[d, i] = s
            region = joined[max(b, s - 2 * k - 1) : max(b, min(e, s + int(self.size[i]) + 2 * k + 1))]
            if edit_search(self.texts[i], region, k) <= k:
                found[d].add(i)


def blocks(items: DataFrame, id_col: str, text: str, rate: float) -> Iterator[Items]:
    """The items in blocks of bounded size, in the order of their ids."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for r in items.select(F.col(id_col), F.col(text).cast("string")).where(F.col(text).isNotNull()).orderBy(id_col, text).toLocalIterator():
        t = normalised(r[1].encode())
        if not t:
            continue
        ids.append(r[0])
        texts.append(t)
        size += len(t)
        if len(ids) >= BLOCK or size >= BLOCK_BYTES:
            yield Items(ids, texts, rate)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, rate)


def matches(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, out: str = "item_ids") -> DataFrame:
    """`docs` with the ids of the items that each text holds (array<long>, in order); all columns of `docs` stay."""
    from pyspark.sql.types import ArrayType, LongType, StructField, StructType

    docs = docs.drop(out).withColumn(text, F.col(f"`{text}`").cast("string"))
    names, at = docs.columns, docs.columns.index(text)
    docs, out_ = docs.toDF(*[f"c{i}" for i in range(len(names))]), "items"  # Spark's Arrow functions take no dots in names
    fields = [*docs.schema.fields, StructField(out_, ArrayType(LongType(), False), False)]
    done = docs.withColumn(out_, F.array().cast("array<bigint>"))
    spark = docs.sparkSession
    for block in blocks(items, item_id, item_text, rate):
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK_BYTES of items and their signs

        def run(batches, sent=sent):
            block = sent.value
            for b in batches:
                for lo in range(0, b.num_rows, 512):
                    part = b.slice(lo, 512)
                    texts = [normalised(t.as_py() or b"") for t in part.column(at).cast(pa.binary())]
                    before = part.column(part.num_columns - 1).to_pylist()
                    now = [sorted({*h, *(block.ids[i] for i in f)}) for h, f in zip(before, block.find(texts), strict=True)]
                    yield pa.record_batch([*part.columns[:-1], pa.array(now, pa.list_(pa.int64()))], names=part.schema.names)

        done = done.mapInArrow(trimming(run), StructType(fields))
    return done.toDF(*names, out)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the benchmark items that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = matches(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")
