"""Removal of long repeated passages by a distributed merge sort of suffixes.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. A sparse set of suffixes is
enough to find all of these strings: the string that starts at p is looked up by its *anchor*, the place of the least
hash among the k-mers of its first half (`SPAN` bytes at most). Equal strings have their anchors at equal offsets, so they meet in
one group of anchor suffixes that share at least half of `length`. About one place in a hundred is an anchor.

1. Anchors whose guaranteed context occurs once in the corpus, by its hash, can't be in a repeat and go no further:
   no string is lost, since equal strings have equal contexts.
2. Tasks cut the suffix at each anchor that is left (and the bytes before it that its strings begin with), sort them
   as runs, front-code the runs (the length of the prefix shared with the suffix before, and the rest) and exchange
   the runs by context.
3. A loser tree merges the runs of a bucket. Its nodes keep the length of the prefix that a loser shares with the
   winner that passed it, so a comparison starts behind what is known to be equal and often needs no bytes at all; the
   merged sequence comes with the shared prefix of neighbours.
4. Where neighbours share a whole context, the tree of common prefixes is walked: suffixes that share d bytes to the
   right of the anchor hold equal strings at offset o if they also share o >= length - d bytes to its left.
5. Spans go back to the documents by (context, suffix) and are cut out.

Equal suffixes of a task are sent once with their number, so copies are counted and not gathered. A context with more
than `HOT` different suffixes would still gather in one task: its strings are counted one by one by two hashes instead,
with partial sums before the shuffle.

Defined results: a null text is empty; texts shorter than `length` stay as they are; repeated rows are copies of each
other and lose all their bytes if they have `length` or more; rows are told apart by a hash of id and text and the
length, so ids may be null or repeated; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import drop, materialise, quoted, shuffle_partitions, table, trimming

LENGTH = 400
#: Bytes that decide an anchor at most, and bytes of a k-mer.
SPAN, K = 200, 16


def wide(length: int) -> int:
    """K-mers that decide an anchor: those of the first SPAN bytes of a string, or of its first half."""
    return min(SPAN, length // 2) - K + 1


#: Different suffixes of one context that a merge task takes.
HOT = 4096
#: Bytes of text looked at in one go, and bytes of suffixes in a run.
SEGMENT, RUN = 1 << 18, 1 << 25
#: Texts that are worth a file of an intermediate table.
FILE = 5000
_PLACE = np.uint64((1 << 22) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    return h ^ (h >> np.uint64(29))


class _Rolling:
    """64-bit polynomial hashes of all substrings of a segment, from prefix sums."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int):
        base = int(_ODD[4 + which])
        n = len(data) + 1
        if which not in self._powers or len(self._powers[which][0]) < n:
            most = max(n, 2 * SEGMENT + 4096)
            up = np.full(most, base, np.uint64)
            down = np.full(most, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self._powers[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        up, self.down = self._powers[which]
        values = np.random.default_rng(17 + which).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values[data] * up[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(data: np.ndarray, ends: np.ndarray, length: int):
    """(first window, windows, anchor, context hash, suffix hash) of each run of windows with one anchor.

    data: the bytes of some texts; ends: where each text ends. A window is a string of `length` bytes of one text.
    """
    n, many = len(data), wide(length)
    if n < length:
        return None
    x = data.astype(np.uint64)
    x = x[:-1] | (x[1:] << np.uint64(8))
    x = x[:-2] | (x[2:] << np.uint64(16))
    x = x[:-4] | (x[4:] << np.uint64(32))
    h = (x[:-8] * _ODD[0]) ^ (x[8:] * _ODD[1])
    h = (h ^ (h >> np.uint64(29))) * _ODD[2]
    h = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= many:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    if size < many:
        h = np.minimum(h[: len(h) - (many - size)], h[many - size :])
    at = (h[: n - length + 1] & _PLACE).astype(np.int64)
    own_end = np.repeat(ends, np.diff(ends, prepend=0))[: n - length + 1]
    p = np.flatnonzero(np.arange(n - length + 1) + length <= own_end)
    if not len(p):
        return None
    m = at[p]
    new = np.flatnonzero(np.concatenate(([True], (m[1:] != m[:-1]) | (p[1:] != p[:-1] + 1))))
    first, count = p[new], np.diff(np.append(new, len(p)))
    anchor = m[new]
    ctx = _Rolling(data, 0).of(anchor, anchor + (length - many + 1))
    full = _Rolling(data, 1).of(first, first + count - 1 + length)
    full ^= _mixed(((anchor - first) * 256 + count).astype(np.uint64))
    return first, count, anchor, ctx, full


def _texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column and where each value ends."""
    col = col.cast(pa.large_binary())
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return data[ends[0] : ends[-1]], ends[1:] - ends[0]


def _segments(ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first text, last text + 1, from, to): whole texts of about SEGMENT bytes, or a part of a longer one."""
    i = 0
    while i < len(ends):
        start = int(ends[i - 1]) if i else 0
        if ends[i] - start > 2 * SEGMENT:
            for at in range(start, int(ends[i]), SEGMENT):
                yield i, i + 1, at, min(int(ends[i]), at + SEGMENT)
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, start + SEGMENT, "right")))
        yield i, j, start, int(ends[j - 1])
        i = j


ANCHOR = "k long, nb long, pos long, ctx long, full long"


def _anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """An ANCHOR row for each run of windows; pos packs the first window, its anchor's offset and the windows."""

    def run(batches):
        for b in batches:
            data, ends = _texts(b.column(1))
            keys = b.column(0).to_numpy()
            starts = np.concatenate(([0], ends[:-1]))
            for i, j, lo, hi in _segments(ends):
                part = data[lo : min(int(ends[j - 1]), hi + length - 1)] if j == i + 1 else data[lo:hi]
                cut = np.minimum(ends[i:j] - lo, len(part))
                if (got := anchors(part, cut, length)) is None:
                    continue
                first, count, anchor, ctx, full = got
                doc = i + np.searchsorted(cut, first, "right")
                pos = ((first + lo - starts[doc]) << 16) | ((anchor - first) << 8) | count
                cols = (keys[doc], (ends - starts)[doc], pos, ctx.view(np.int64), full.view(np.int64))
                yield pa.record_batch([pa.array(c) for c in cols], names=["k", "nb", "pos", "ctx", "full"])

    return docs.select("k", "text").mapInArrow(trimming(run), ANCHOR)


# --- front-coded runs -------------------------------------------------------------------------------------------

_HEAD = struct.Struct("<II")


def shared(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the common prefix, known to be at least `low`."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def pack_run(entries: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """A sorted run of (right, left, number, ctx, full): rights front-coded, lefts beside them."""
    lcp, sizes, rest, last = [], [], [], b""
    for right, left, *_ in entries:
        n = shared(last, right)
        lcp.append(n)
        sizes.append((len(right) - n, len(left)))
        rest += (right[n:], left)
        last = right
    fixed = np.array(lcp, "<u4").tobytes() + np.array(sizes, "<u4").tobytes() + np.array([e[2:] for e in entries], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(_HEAD.pack(len(entries), len(fixed)) + fixed + b"".join(rest))


def unpack_run(blob: bytes) -> Iterator[tuple[int, bytes, bytes, int, int, int]]:
    """(prefix shared with the one before, right, left, number, ctx, full) in order."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, fixed = _HEAD.unpack_from(data)
    at = _HEAD.size
    lcp = np.frombuffer(data, "<u4", n, at).tolist()
    sizes = np.frombuffer(data, "<u4", 2 * n, at + 4 * n).reshape(n, 2).tolist()
    rest = np.frombuffer(data, "<i8", 3 * n, at + 12 * n).reshape(n, 3).tolist()
    at, last = at + fixed, b""
    for h, (a, b), more in zip(lcp, sizes, rest, strict=True):
        last = last[:h] + data[at : at + a]
        yield h, last, data[at + a : at + a + b], *more
        at += a + b


class LoserTree:
    """Merges sorted runs; yields (prefix shared with the entry before, entry).

    A node holds the run that lost there and the prefix it shares with the run that won. A run that comes up with more
    shared bytes than the loser is the smaller one, with fewer it is the larger one, and only a tie is decided by
    bytes, from the shared prefix on.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.n = runs, len(runs)
        self.compared = 0

    def _less(self, a: tuple, b: tuple, h: int) -> tuple[bool, int]:
        """Whether a goes first, and the prefix that both share."""
        self.compared += 1
        h = shared(a[1], b[1], h)
        x, y = a[1][h : h + 1], b[1][h : h + 1]
        return (x, a[2]) <= (y, b[2]) if x == y else x < y, h

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        n = self.n
        heads: list[tuple | None] = [next(r, None) for r in self.runs]
        tree: list[tuple[int, int]] = [(-1, 0)] * n  # (run, prefix shared with the winner)

        def play(i: int, h: int, node: int) -> tuple[int, int]:
            """Run i, which shares h bytes with the last winner, meets the loser of a node: the winner of both."""
            j, g = tree[node]
            if j < 0 or heads[j] is None:
                return i, h
            if heads[i] is None or g > h:
                tree[node] = (i, h)
                return j, g
            if h > g:
                return i, h
            first, both = self._less(heads[i], heads[j], h)
            tree[node] = (j, both) if first else (i, both)
            return (i, h) if first else (j, g)

        def build(node: int) -> tuple[int, int]:
            if node >= n:
                return node - n, 0
            left, h = build(2 * node)
            right, g = build(2 * node + 1)
            tree[node] = (right, g)
            return play(left, h, node)

        if not n:
            return
        win, h = build(1) if n > 1 else (0, 0)
        while heads[win] is not None:
            yield h, heads[win]
            heads[win] = nxt = next(self.runs[win], None)
            h = nxt[0] if nxt else 0
            node = (win + n) // 2
            while node:
                win, h = play(win, h, node)
                node //= 2


def group_spans(rights: list[bytes], lefts: list[bytes], numbers: list[int], lcp: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each suffix of a context the offsets (from, to, inclusive) of its strings that occur elsewhere.

    Suffixes are sorted and different; lcp[i] is shared by i - 1 and i. Offset o is the string that starts o bytes left
    of the anchor.
    """
    n = len(rights)
    own = [(max(0, length - len(r)), len(le)) for r, le in zip(rights, lefts, strict=True)]
    out: list[list[tuple[int, int]]] = [[o] if c > 1 else [] for o, c in zip(own, numbers, strict=True)]
    stack = [(0, n, length - wide(length))]
    while stack:
        lo, hi, above = stack.pop()
        if hi - lo < 2:
            continue
        d = min(min(lcp[lo + 1 : hi]), length)
        low, high = length - d, length - above - 1
        if low <= high:
            order = sorted(range(lo, hi), key=lefts.__getitem__)
            before = 0
            for x, i in enumerate(order):
                after = shared(lefts[i], lefts[order[x + 1]]) if x + 1 < len(order) else 0
                a, b = max(low, own[i][0]), min(high, own[i][1], max(before, after))
                if a <= b:
                    out[i].append((a, b))
                before = after
        if d < length:
            cuts = [lo, *(i for i in range(lo + 1, hi) if lcp[i] <= d), hi]
            stack += [(a, b, d) for a, b in zip(cuts, cuts[1:], strict=False)]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive spans, sorted and joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _window_hashes(text: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, other hash, first byte) of each string of some suffixes; only their own bytes are looked at."""
    p, h1, h2 = [], [], []
    for x in pos.tolist():
        first, count = x >> 16, x & 255
        part, i = text[first : first + count - 1 + length], np.arange(count)
        p.append(first + i)
        h1.append(_Rolling(part, 0).of(i, i + length))
        h2.append(_Rolling(part, 1).of(i, i + length))
    return tuple(np.concatenate(x).astype(np.uint64).view(np.int64) for x in (h1, h2, p))


_CUT = "bucket int, run binary, h1 long, h2 long, k long, nb long, p long"


def _cut(docs: DataFrame, wanted: DataFrame, length: int, buckets: int) -> DataFrame:
    """Front-coded runs (bucket, run) of the wanted suffixes, and a row for each string of those with a hot context."""
    lists = wanted.groupBy("k", "nb").agg(F.collect_set(F.struct("pos", "ctx", "full", "hot")).alias("wanted"))
    both = docs.join(lists, ["k", "nb"]).select("text", "wanted", "k", "nb")
    kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["bucket", "run", "h1", "h2", "k", "nb", "p"]

    def run(batches):
        seen: dict[tuple[int, int], list] = {}
        size = 0

        def flush():
            by_bucket: dict[int, list] = {}
            for (ctx, full), (right, left, number) in seen.items():
                by_bucket.setdefault(ctx % buckets, []).append((right, left, number, ctx, full))
            for bucket, entries in by_bucket.items():
                entries.sort()
                cols = [[bucket], [pack_run(entries)], *[[None]] * 5]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            for t, w, k, nb in zip(b.column(0), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                text, w = t.as_py(), w.values
                places, hot = w.field(0).to_numpy(), w.field(3).to_numpy(zero_copy_only=False)
                for at in range(0, int(hot.sum()), 512):
                    h1, h2, p = _window_hashes(np.frombuffer(text, np.uint8), places[hot][at : at + 512], length)
                    n = len(p)
                    cols = (pa.nulls(n, kinds[0]), pa.nulls(n, kinds[1]), pa.array(h1), pa.array(h2), pa.array(np.full(n, k)), pa.array(np.full(n, nb)), pa.array(p))
                    yield pa.record_batch(list(cols), names=names)
                for pos, ctx, full, is_hot in zip(places.tolist(), w.field(1).to_pylist(), w.field(2).to_pylist(), hot.tolist(), strict=True):
                    if is_hot:
                        continue
                    if (e := seen.get((ctx, full))) is not None:
                        e[2] += 1
                        continue
                    first, offset, count = pos >> 16, pos >> 8 & 255, pos & 255
                    a = first + offset
                    seen[ctx, full] = [text[a : first + count - 1 + length], text[first:a][::-1], 1]
                    size += length + count + 100
                if size > RUN:
                    yield from flush()
                    seen.clear()
                    size = 0
        yield from flush()

    return both.mapInArrow(trimming(run), _CUT)


def _merge(runs: DataFrame, length: int) -> DataFrame:
    """(ctx, full, spans of offsets) of suffixes that hold repeated strings."""

    def run(batches):
        def results(blobs):
            rights, lefts, numbers, keys, lcp = [], [], [], [], []

            def group():
                if len(keys) > 1 or numbers[0] > 1:
                    for key, spans in zip(keys, group_spans(rights, lefts, numbers, lcp, length), strict=True):
                        if spans:
                            yield *key, merged(spans)

            for h, (_, right, left, number, ctx, full) in LoserTree([unpack_run(x) for x in blobs]):
                if keys and h <= length - wide(length):
                    yield from group()
                    for x in (rights, lefts, numbers, keys, lcp):
                        x.clear()
                if keys and right == rights[-1] and left == lefts[-1]:
                    numbers[-1] += number
                    continue
                for x, v in zip((rights, lefts, numbers, keys, lcp), (right, left, number, (ctx, full), h), strict=True):
                    x.append(v)
            if keys:
                yield from group()

        def batch(rows):
            ctx, full, spans = zip(*rows, strict=True)
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            return pa.record_batch([pa.array(ctx, pa.int64()), pa.array(full, pa.int64()), pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], kind)], names=["ctx", "full", "spans"])

        def bucket(blobs):
            rows = []
            for r in results(blobs):
                rows.append(r)
                if len(rows) == 20_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

        now, blobs = None, []
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != now and blobs:
                    yield from bucket(blobs)
                    blobs = []
                now = k
                blobs.append(blob.as_py())
        if blobs:
            yield from bucket(blobs)

    dealt = runs.repartition(shuffle_partitions(runs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(trimming(run), "ctx long, full long, spans array<struct<a:int,b:int>>")


def _counted(rows: DataFrame, length: int) -> DataFrame:
    """(k, nb, a, b) of the strings of hot contexts that occur twice or more."""
    again = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return rows.join(again, ["h1", "h2"]).select("k", "nb", F.col("p").alias("a"), (F.col("p") + length).alias("b"))


def _found(docs: DataFrame, id_col: str, text: str, length: int, hot: int, keep: tuple[str, ...]) -> DataFrame:
    """(id, `keep` columns, text as bytes, found: the repeated strings (a, b) of the text, or null)."""
    if length < 4 * K:
        raise ValueError(f"length must be {4 * K} or more")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.encode(F.coalesce(F.col(text).cast("string"), F.lit("")), "UTF-8").alias("text"))
    rows = rows.withColumn("k", F.xxhash64("id", "text")).withColumn("nb", F.length("text").cast("long"))
    long = rows.where(F.col("nb") >= length).select("k", "nb", "text")
    files = 1 + docs.count() // FILE
    found = materialise(_anchor_table(long, length), "suffix-anchors")
    # a table of its own: adaptive execution can then split a context that very many anchors have
    twice = materialise(found.groupBy("ctx").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ctx"), "suffix-twice", files)
    wanted = materialise(found.join(twice, "ctx").select("k", "nb", "pos", "ctx", "full"), "suffix-wanted", files)
    drop(found)
    drop(twice)
    crowded = wanted.select("ctx", "full").distinct().groupBy("ctx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("ctx")
    crowded = materialise(crowded, "suffix-hot", files)
    many = not crowded.isEmpty()
    if many:
        wanted = wanted.join(crowded.withColumn("hot", F.lit(True)), "ctx", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    else:
        wanted = wanted.withColumn("hot", F.lit(False))
    cut = materialise(_cut(long, wanted, length, 4 * shuffle_partitions(spark)), "suffix-runs", files)
    plain = wanted.where(~F.col("hot"))
    answers = _merge(cut.where(F.col("run").isNotNull()).select("bucket", "run"), length)
    by_place = plain.join(answers, ["ctx", "full"]).select("k", "nb", "pos", F.explode("spans").alias("s"))
    anchor = F.shiftright("pos", 16) + F.shiftright("pos", 8).bitwiseAND(F.lit(255))
    spans = by_place.select("k", "nb", (anchor - F.col("s.b")).alias("a"), (anchor - F.col("s.a") + length).alias("b"))
    if many:
        spans = spans.unionByName(_counted(cut.where(F.col("run").isNull()).select("h1", "h2", "k", "nb", "p"), length))
    lists = spans.groupBy("k", "nb").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    return rows.join(lists, ["k", "nb"], "left").select("id", *keep, "text", "found")


def _kept(text: bytes, found) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes that stay, and the removed runs (inclusive)."""
    if not found.is_valid:
        return text, []
    w = found.values
    gone = merged(list(zip(w.field(0).to_pylist(), (w.field(1).to_numpy() - 1).tolist(), strict=True)))
    edges = [0, *(x for a, z in gone for x in (a, z + 1)), len(text)]
    return b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)), gone


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, hot: int = HOT, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, `keep` columns, n_bytes, spans, kept): the removed runs of bytes, and the bytes that stay.

    `length` is 4 * K or more.
    """
    both = _found(docs, id_col, text, length, hot, keep)
    names = ["id", *keep]

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                n, cut, kept = [], [], []
                for t, f in zip(part.column(len(names)), part.column(len(names) + 1), strict=True):
                    t = t.as_py()
                    rest, gone = _kept(t, f)
                    n.append(len(t))
                    kept.append(rest)
                    cut.append([{"start": a, "end": z + 1} for a, z in gone])
                yield pa.record_batch([*part.columns[: len(names)], pa.array(n, pa.int64()), pa.array(cut, kind), pa.array(kept, pa.binary())], names=[*names, "n_bytes", "spans", "kept"])

    from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    fields = [both.schema[c] for c in names]
    return both.mapInArrow(trimming(run), StructType([*fields, StructField("n_bytes", LongType()), StructField("spans", ArrayType(span)), StructField("kept", BinaryType())]))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """`docs` with the repeated passages cut out of `text`, and `n_chars` (if it is there) counted anew.

    Characters of which a cut leaves only a part go with it; a null text stays null; no row goes.
    """
    others = [c for c in docs.columns if c != text]
    src = docs.select(F.lit(None).alias("_id") if not others else F.struct(*quoted(others)).alias("_all"), F.col(text).isNull().alias("_null"), text)
    both = _found(src, src.columns[0], text, length, HOT, ("_null",))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                kept = [None if z else _kept(t.as_py(), f)[0].decode("utf-8", "ignore") for z, t, f in zip(part.column(1).to_pylist(), part.column(2), part.column(3), strict=True)]
                yield pa.record_batch([part.column(0), pa.array(kept, pa.string())], names=["id", "t"])

    from pyspark.sql.types import StringType, StructField, StructType

    back = both.mapInArrow(trimming(run), StructType([both.schema["id"], StructField("t", StringType())]))
    cols = {c: F.col("id")[c] for c in others} | {text: F.col("t")}
    if n_chars in cols:
        kind = docs.schema[n_chars].dataType
        cols[n_chars] = F.when(F.col("t").isNull(), cols[n_chars]).otherwise(F.length("t")).cast(kind)
    return back.select(*[cols[c].alias(c) for c in docs.columns])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: DuckDB: all strings of 400 bytes by their digests, runs of those that occur again, and what is left.
SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, md5(b[p + 1 : p + 400]) AS h FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 399)) AS p FROM d WHERE octet_length(b) >= 400)),
r AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 400 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN (SELECT h FROM w GROUP BY h HAVING count(*) > 1) USING (h)),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 400 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM r) GROUP BY ALL),
e AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM s GROUP BY 1),
k AS (SELECT d.doc_id, octet_length(b) AS n, coalesce(len(a), 0) AS spans, b, list_prepend(0, coalesce(z, [])) AS f, list_append(coalesce(a, []), octet_length(b)) AS t FROM d LEFT JOIN e USING (doc_id)),
q AS (SELECT doc_id, n, spans, unhex(list_aggregate(list_transform(range(1, len(f) + 1), lambda i: hex(b[f[i] + 1 : t[i]])), 'string_agg', '')) AS kept FROM k)
SELECT doc_id, n::BIGINT AS n_bytes, (n - octet_length(kept))::BIGINT AS n_removed, spans::BIGINT AS n_spans, sha256(kept) AS kept_sha256 FROM q
"""


def brute_removed(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """The definition, for tests: the removed runs of each text."""
    seen: dict[bytes, int] = {}
    name = lambda s: hashlib.blake2b(s, digest_size=16).digest()
    keys = [[name(t[p : p + length]) for p in range(len(t) - length + 1)] for t in texts]
    for ks in keys:
        for x in ks:
            seen[x] = seen.get(x, 0) + 1
    return [[(a, b + 1) for a, b in merged([(p, p + length - 1) for p, x in enumerate(ks) if seen[x] > 1])] for ks in keys]
