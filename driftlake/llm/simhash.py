"""SimHash near-duplicates: a self-join of binary tries over the fingerprints.

Fingerprints are made in one pass over the texts; equal ones are one vertex from then on. The trie of all distinct
fingerprints is walked in pairs of nodes: each level adds a differing bit to the pairs that took different branches,
and a pair whose sum exceeds the budget is dropped with all that lies below it. To spread one trie over many tasks,
the 64 bits are cut in budget + 2 blocks; two fingerprints within the budget agree on at least two of them, so for
each choice of two blocks the trie that has these two on top needs to be walked only below nodes that agree there:
the key of a task group. A group too large for a task is cut again in the same way over its remaining bits, which
bounds it to 2^16 fingerprints (for 64 bits and a budget of 2), whatever the data hold.

Walks return links that span each connected piece, not all its pairs. Components follow from these links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import materialise, table
from driftlake.llm.components import components

BITS = 64
#: A task group with more fingerprints than this is cut again.
GROUP = 4096
#: Texts are split into words in pieces of about so many bytes.
PIECE = 1 << 20
#: Node pairs expanded at once.
FRONT = 1 << 18


def word_pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of `text`, a list for each piece of it; memory is bounded by the piece and the longest word."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end
    yield text[at:].split()


def _bit_counts(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of a UTF-8 text, repeats included; 0 where there is no word."""
    digest, counts, n, tail = xxhash.xxh64_intdigest, None, 0, []
    for words in word_pieces((text or b"").lower()):
        words = tail + words
        if len(words) < shingle:
            tail = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: -shingle] + 1)).tolist()
        h = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
        c = _bit_counts(h)
        counts, n, tail = c if counts is None else counts + c, n + len(h), words[len(words) - shingle + 1 :]
    if not n:
        return digest(b" ".join(tail), 42) if tail else 0
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long) of each row; a null text counts as empty."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, fp long")


class _Sets:
    """Union-find over 0..n-1 whose labels can be compared in bulk."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def labels(self) -> np.ndarray:
        up = np.array(self.up)
        while not np.array_equal(up, nxt := up[up]):
            up = nxt
        self.up = up.tolist()
        return up


def trie_links(values: np.ndarray, groups: np.ndarray, top: int, budget: int, bits: int = BITS) -> list[tuple[int, int]]:
    """Links (i, j) that span the pieces of the graph "within `budget` bits of each other".

    values: uint64, sorted within each group and distinct there; groups: the first index of each group and the end;
    top: leading bits that a group's values share. The tries are implicit: a node is a range of sorted values.
    """
    sets, links = _Sets(len(values)), []
    label = np.arange(len(values))
    lo, hi = groups[:-1], groups[1:]
    keep = hi - lo > 1
    stack = [(top, lo[keep], hi[keep], lo[keep], hi[keep], np.zeros(int(keep.sum()), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, ul, uh, vl, vh, cost = stack.pop()
        if len(ul) > FRONT:
            stack.append((depth, *(x[FRONT:] for x in (ul, uh, vl, vh, cost))))
            ul, uh, vl, vh, cost = (x[:FRONT] for x in (ul, uh, vl, vh, cost))
        single = (uh - ul == 1) & (vh - vl == 1)
        if single.any():
            a, b = ul[single], vl[single]
            near = (label[a] != label[b]) & (np.bitwise_count(values[a] ^ values[b]) <= budget)
            made = [(x, y) for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True) if sets.join(x, y)]
            if made:
                links += made
                label = sets.labels()
            ul, uh, vl, vh, cost = (x[~single] for x in (ul, uh, vl, vh, cost))
        if not len(ul) or depth >= bits:
            continue
        if depth not in ones:
            bit = (values >> np.uint64(bits - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
        c = ones[depth]
        um, vm = uh - (c[uh] - c[ul]), vh - (c[vh] - c[vl])
        same = (ul == vl) & (uh == vh)
        other = ~same
        parts = [
            (ul, um, vl, vm, cost),
            (um, uh, vm, vh, cost),
            (ul, um, vm, vh, cost + 1),
            tuple(x[other] for x in (um, uh, vl, vm, cost + 1)),
        ]
        ul, uh, vl, vh, cost = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (uh > ul) & (vh > vl) & (cost <= budget) & ~((ul == vl) & (uh - ul == 1) & (vh - vl == 1))
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in (ul, uh, vl, vh, cost))))
    return links


def _layouts(width: int, budget: int, bits: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Ways to put two of the budget + 2 blocks of the low `width` bits on top: (bits on top, [(shift, bits), ...])."""
    n = budget + 2
    edges = [round(i * width / n) for i in range(n + 1)]
    blocks = [(width - edges[i + 1], edges[i + 1] - edges[i]) for i in range(n)]
    out = []
    for pick in combinations(range(n), 2):
        order = [blocks[i] for i in pick] + [b for i, b in enumerate(blocks) if i not in pick]
        out.append((sum(b for _, b in order[:2]), order))
    return out


def _arranged(v: Column, order: list[tuple[int, int]], width: int) -> Column:
    """`v` with the blocks of its low `width` bits in this order; the bits above stay."""
    out, left = None, width
    for shift, size in order:
        left -= size
        part = F.shiftleft(F.shiftrightunsigned(v, shift).bitwiseAND(F.lit((1 << size) - 1)), left)
        out = part if out is None else out.bitwiseOR(part)
    if width < BITS:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(v, width), width))
    return out


def _spread(df: DataFrame, width: int, budget: int, layout: Column) -> tuple[DataFrame, int]:
    """Each value once for each layout of its low bits: (layout, key, at: the arranged value, fp)."""
    ways = _layouts(width, budget, BITS)
    low = width - min(top for top, _ in ways)
    rows = F.array(*[F.struct((layout * 16 + i).alias("layout"), _arranged(F.col("at"), order, width).alias("at")) for i, (_, order) in enumerate(ways)])
    out = df.select("fp", F.explode(rows).alias("r")).select("r.layout", F.shiftrightunsigned("r.at", low).alias("key"), "r.at", "fp")
    return out, low


def hamming_links(fps: DataFrame, budget: int = 2, group: int = GROUP) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that span the pieces within `budget` bits."""
    first, low1 = _spread(fps.select(F.col("fp").alias("at"), "fp"), BITS, budget, F.lit(0))
    sizes = first.groupBy("layout", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = first.join(sizes, ["layout", "key"])
    small = pairs.where(F.col("n") <= group).select("layout", "key", "at", "fp")
    second, low2 = _spread(pairs.where(F.col("n") > group), low1, budget, F.col("layout") + 1)
    second = second.select((F.col("layout") + 4096).alias("layout"), "key", "at", "fp")

    def run(batches):
        def flush(parts):
            t = pa.Table.from_batches(parts)
            lay, key, at, fp = (t.column(i).to_numpy() for i in range(4))
            deep = lay >= 4096
            for which, top in ((~deep, BITS - low1), (deep, BITS - low2)):
                if which.any():
                    k = np.stack([lay[which], key[which]])
                    cut = np.concatenate(([0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [k.shape[1]]))
                    values, own = at[which].astype(np.int64).view(np.uint64), fp[which]
                    found = trie_links(values, cut, top, budget)
                    if found:
                        a = np.array(found)
                        yield pa.record_batch([pa.array(own[a[:, 0]]), pa.array(own[a[:, 1]])], names=["u", "v"])

        held, rows = [], 0
        for b in batches:
            held, rows = held + [b], rows + b.num_rows
            if rows < 50_000:
                continue
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lay, key = t.column(0).to_numpy(), t.column(1).to_numpy()
            start = int(np.flatnonzero((lay != lay[-1]) | (key != key[-1]))[-1]) + 1 if ((lay != lay[-1]) | (key != key[-1])).any() else 0
            if start:  # the last group may go on in the next batch
                yield from flush([t.slice(0, start)])
            held, rows = [t.slice(start)], len(lay) - start
        if rows:
            yield from flush(held)

    groups = small.unionByName(second).repartition("layout", "key")
    unsigned = F.col("at").bitwiseXOR(F.lit(-(1 << 63)))
    return groups.withColumn("o", unsigned).sortWithinPartitions("layout", "key", "o").drop("o").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """(id, fp, component): fingerprint of each row, and the least id that links of `budget` bits reach from it.

    Defined results: a null or empty text has fingerprint 0 and is linked like any other; a null id takes part and
    gets the least non-null id of its component, or null where it has none; repeated rows get a row each; an empty
    table gives an empty result; other columns of `docs` are not read.
    """
    rows = materialise(fingerprints(docs, id_col, text, shingle), "fingerprints")
    vertices = rows.groupBy("fp").agg(F.min("id").alias("least"))
    root = components(hamming_links(vertices.select("fp"), budget))
    named = vertices.join(root, vertices.fp == root.u, "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    linked = named.where("root <> fp").select("root").distinct()
    heads = named.join(linked, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component"))
    by_fp = named.join(heads, "root", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return rows.join(by_fp, "fp").select("id", "fp", "component")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
