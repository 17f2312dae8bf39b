"""Near copies: texts whose sets of five-word shingles are 0.8 similar or more, by SimHash tries and shared shingles.

1. Tries: each text has `TABLES` fingerprints of its set of words; those within `BUDGET` bits are linked by the trie
   self-join of simhash.py. This finds most links, not all: it returns links that span pieces, and a passage that is
   added changes a set of words as much as the shingles.
2. Shared shingles: in one order of all shingles (frequent ones last, by a sample; the order bears on speed only) two
   sets of 0.8 similarity or more have a shingle of their prefixes, about a fifth of each set, in common. For each
   shingle the text that shares most with others is linked to all texts that have it.
3. All these links are verified by the exact Jaccard similarity, and components are made of those that hold.
4. All pairs that share a shingle of their prefixes and are not in one component by then are verified too. So the
   groups are those of all pairs, whatever the steps before have left out.

Before a pair is verified, it is held against a lower bound of what differs: each set has the parities of its
`PARITY` buckets, and every parity in which two sets differ takes a shingle that only one of them has. A pair that may
not differ as much is dropped; no pair of 0.8 similarity is. Sets of more than `PARITY` shingles have as many buckets as
shingles or more besides, since few buckets bound nothing there, and their pairs are held against those too.

Texts that are equal are one vertex throughout. Where more than `TILE` texts share a shingle, their pairs are dealt out
in tiles; texts that are in the component of the one with most shared shingles are not paired with one another.

Defined results: null and empty texts are equal to each other; texts of fewer than five words have their words as the
one shingle; of a group the row with the least id stays (null ids last, then by a hash of the row), of rows that are
equal in all columns one stays; an empty table gives an empty result; all columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.llm.common import bounded, drop, materialise, quoted, trimming, unused
from driftlake.llm.components import components
from driftlake.llm.simhash import hamming_links

SHINGLE, SIMILAR = 5, 0.8
TABLES, BUDGET = 2, 3
#: Buckets of a set whose parities are kept; of a larger set there are up to MOST_PARITY besides.
PARITY, MOST_PARITY = 512, 1 << 22
#: One text in SAMPLE is counted to find frequent shingles; at most HOT of them go to the end of the order.
SAMPLE, HOT = 16, 50_000
#: Texts of a tile, where many texts share a shingle.
TILE = 1024
#: Texts that are worth a file of an intermediate table.
FILE = 5000
#: Keys of rows that are sent to all executors, at most: of more the texts are shuffled.
KEYS = 1_000_000
#: Bytes of texts hashed at once, and what a longer text is cut in.
SEGMENT = 1 << 18
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_VALUES = np.random.default_rng(29).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers: list[np.ndarray] = []


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, A-Z lower-cased, and the text of each; ends: where each text ends in `data`."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not _powers or len(_powers[0]) < n + 1:
        _powers[:] = [np.full(max(n + 1, SEGMENT + 1), x, np.uint64) for x in (int(_ODD[5]), pow(int(_ODD[5]), -1, 1 << 64))]
        for p in _powers:
            p[0] = 1
            np.multiply.accumulate(p, out=p)
    up, down = _powers
    solid = ~_SPACE[data]
    new = np.zeros(n + 1, bool)  # places where a text begins
    new[ends] = True
    before = np.concatenate(([False], solid[:-1]))
    after = np.concatenate((solid[1:], [False]))
    start = np.flatnonzero(solid & (~before | new[:n]))
    end = np.flatnonzero(solid & (~after | new[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[_LOWER[data]] * up[:n], out=sums[1:])
    h = _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _ODD[0])
    return h, np.searchsorted(ends, start, "right")


def _joined(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE words; of all words, where they are fewer."""
    k = min(SHINGLE, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out += words[i : len(words) - k + 1 + i] * _ODD[i]
    return _mixed(out)


def _pieces(text: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces of about SEGMENT bytes that end with a word."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SEGMENT)
        while end < len(text) and not _SPACE[text[end]]:
            rest = _SPACE[text[end : end + SEGMENT]]
            end += int(rest.argmax()) if rest.any() else len(rest)
        yield text[at:end]
        at = end


def sets(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of the words, hashes of the shingles) of each text, sorted sets of uint64; null counts as empty."""
    col = col.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(col):
        if ends[i + 1] - ends[i] > SEGMENT:
            words, shingles, tail = [], [], np.zeros(0, np.uint64)
            for piece in _pieces(data[ends[i] : ends[i + 1]]):
                h = word_hashes(piece, np.array([len(piece)]))[0]
                words.append(np.unique(h))
                tail = np.concatenate((tail, h))
                if len(tail) >= SHINGLE:
                    shingles.append(np.unique(_joined(tail)))
                    tail = tail[len(tail) - SHINGLE + 1 :]
            yield np.unique(np.concatenate(words)), np.unique(np.concatenate(shingles or [_joined(tail)]))
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SEGMENT, "right")) - 1)
        h, own = word_hashes(data[ends[i] : ends[j]], ends[i + 1 : j + 1] - ends[i])
        cut = np.searchsorted(own, np.arange(j - i + 1)).tolist()
        for a, b in zip(cut, cut[1:], strict=False):
            yield np.unique(h[a:b]), np.unique(_joined(h[a:b]))
        i = j


def fingerprints(words: list[np.ndarray]) -> np.ndarray:
    """TABLES fingerprints of each set of words: (sets, TABLES), signed; 0 for a set without words."""
    out = np.zeros((len(words), TABLES), np.int64)
    some = [i for i, w in enumerate(words) if len(w)]
    if some:
        h, n = np.concatenate([words[i] for i in some]), np.array([len(words[i]) for i in some])
        for t in range(TABLES):
            bits = np.unpackbits(_mixed(h + _ODD[t]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            most = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64) * 2 > n[:, None]
            out[some, t] = np.packbits(most, axis=1, bitorder="little").view(np.int64)[:, 0]
    return out


def parities(shingles: list[np.ndarray]) -> np.ndarray:
    """(sets, PARITY / 64) longs: whether each bucket has an odd number of shingles."""
    own = np.repeat(np.arange(len(shingles)), [len(s) for s in shingles])
    at = own * PARITY + (np.concatenate(shingles) >> np.uint64(40)).astype(np.int64) % PARITY
    odd = np.bincount(at, minlength=len(shingles) * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(shingles), PARITY // 64)


def fine_parities(shingles: list[np.ndarray]) -> list[np.ndarray]:
    """For each set of more than PARITY shingles the parities of at least as many buckets, a power of two; else nothing.

    A bucket is the low bits of a number, so the halves of an array, one XOR the other, are those of half as many buckets.
    """
    out = []
    for s in shingles:
        many = min(MOST_PARITY, 1 << (len(s) - 1).bit_length()) if len(s) > PARITY else 0
        odd = np.bincount((s >> np.uint64(40)).astype(np.int64) % many, minlength=many) & 1 if many else np.zeros(0, np.int64)
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
    return out


def frequent(rows: DataFrame) -> np.ndarray:
    """Frequent shingles of a sample of texts, rarest first. They set an order and decide nothing else."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found = [s for _, s in sets(b.column(0).slice(at, 256))]
                yield pa.record_batch([pa.array(np.concatenate(found).view(np.int64))], names=["h"])

    some = rows.where(F.pmod("t1", F.lit(SAMPLE)) == 0).select("text").mapInArrow(trimming(run), "h long")
    found = some.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(HOT).toArrow()
    return found["h"].to_numpy().astype(np.int64).view(np.uint64)[::-1]


def prefix(shingles: np.ndarray, hot: tuple[np.ndarray, np.ndarray], similar: float) -> np.ndarray:
    """The first shingles in the order of all texts, rare ones first: two sets that are similar share one of these.

    hot: the frequent shingles, sorted, and the place of each in the order.
    """
    n, order = len(shingles), shingles >> np.uint64(1)
    if len(hot[0]):
        i = np.minimum(np.searchsorted(hot[0], shingles), len(hot[0]) - 1)
        order = np.where(hot[0][i] == shingles, hot[1][i], order)
    return shingles[np.argsort(order, kind="stable")[: n - int(np.ceil(similar * n - 1e-9)) + 1]]


def features(rows: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """`rows` (with a column text, the last) with f, x, y, p and n in its place: fingerprints, parities, those of more buckets, prefix and number of shingles."""
    common = frequent(rows)
    by_hash = np.argsort(common)
    sent = rows.sparkSession.sparkContext.broadcast((common[by_hash], by_hash.astype(np.uint64) + np.uint64(1 << 63)))  # HOT at most

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                words, shingles = zip(*sets(part.column(part.num_columns - 1)), strict=True)
                first = [prefix(s, sent.value, similar).view(np.int64) for s in shingles]
                lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], np.int32), m.ravel())
                ragged = lambda v: pa.ListArray.from_arrays(np.cumsum([0, *map(len, v)]).astype(np.int32), np.concatenate(v))
                made = [lists(fingerprints(words)), lists(parities(shingles)), ragged(fine_parities(shingles)), ragged(first), pa.array([len(s) for s in shingles], pa.int32())]
                yield pa.record_batch([*part.columns[:-1], *made], names=[*part.schema.names[:-1], "f", "x", "y", "p", "n"])

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

    longs = ArrayType(LongType())
    own = [StructField("f", longs), StructField("x", longs), StructField("y", longs), StructField("p", longs), StructField("n", IntegerType())]
    return rows.mapInArrow(trimming(run), StructType([*rows.drop("text").schema.fields, *own]))


def _may(a: str, b: str, similar: float) -> Column:
    """Whether two texts whose first common shingle is this one can be similar, by their sizes and its places."""
    n, m, i, j = (F.col(f"{x}.{c}") for c in ("n", "at") for x in (a, b))
    return F.least(n - i, m - j) >= F.ceil(F.lit(similar / (1 + similar)) * (n + m) - F.lit(1e-9))


def _tries(reps: DataFrame, files: int) -> DataFrame:
    """Links of texts with one fingerprint to the least of them, and of the fingerprints that the trie self-join links."""
    made = reps.select("t1", F.posexplode("f").alias("table", "fp")).groupBy("table", "fp")
    heads = materialise(made.agg(F.min("t1").alias("head")), "near-values", files)
    links = reps.select("t1", F.posexplode("f").alias("table", "fp")).join(heads, ["table", "fp"]).where("t1 <> head").select(F.col("head").alias("u"), F.col("t1").alias("v"))
    for t in range(TABLES):
        own = heads.where(F.col("table") == t).select("fp", "head")
        found = hamming_links(own.select("fp"), BUDGET).withColumnsRenamed({"u": "a", "v": "b"})
        ends = found.join(own.select(F.col("fp").alias("a"), F.col("head").alias("u")), "a").join(own.select(F.col("fp").alias("b"), F.col("head").alias("v")), "b")
        links = links.unionByName(ends.select("u", "v"))
    return links


def _shared(reps: DataFrame, files: int) -> tuple[DataFrame, DataFrame]:
    """A table of the texts whose prefixes have a shingle, where there are two or more; and (sh, m, r: (score, t1, n, at)) from it."""
    rows = reps.select("t1", "n", F.posexplode("p").alias("at", "sh")).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("sh")))
    rows = materialise(rows.where("m > 1"), "near-shared", files)
    score = rows.groupBy("t1").agg((F.sum("m") / F.first("n")).cast("float").alias("score"))
    scored = materialise(rows.join(score, "t1"), "near-scored", files)  # its shuffles go before the pairs are made
    drop(rows)
    return scored, scored.select("sh", "m", F.struct("score", "t1", "n", "at").alias("r"))


def _stars(shared: DataFrame, similar: float) -> DataFrame:
    """Links of each text to the one that shares most with others, for each shingle."""
    tops = shared.groupBy("sh").agg(F.max("r").alias("top"))
    far = shared.join(tops, "sh").where((F.col("r.t1") != F.col("top.t1")) & _may("r", "top", similar))
    return far.select(F.col("top.t1").alias("u"), F.col("r.t1").alias("v"))


def _others(shared: DataFrame, root: DataFrame, similar: float) -> DataFrame:
    """All pairs that share a shingle of their prefixes and that verified links do not connect yet."""
    named = shared.withColumn("t1", F.col("r.t1")).join(root.select(F.col("u").alias("t1"), "v"), "t1", "left")
    named = named.select("sh", "r", "m", F.coalesce("v", "t1").alias("label"))
    tops = named.groupBy("sh").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max(F.struct("r", "label")).getField("label").alias("main")).where("lo < hi")
    rows = named.join(tops.select("sh", "main"), "sh").withColumn("tiles", F.ceil(F.col("m") / TILE).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("r.t1"), F.col("tiles")).cast("int")).withColumn("each", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    a = rows.where("label <> main").select("sh", F.col("own").alias("i"), F.col("each").alias("j"), F.col("r").alias("a"), F.col("label").alias("la"))
    b = rows.select("sh", F.col("each").alias("i"), F.col("own").alias("j"), F.col("r").alias("b"), F.col("label").alias("lb"), "main")
    once = (F.col("lb") == F.col("main")) | (F.col("a.t1") < F.col("b.t1"))
    both = a.join(b, ["sh", "i", "j"]).where((F.col("la") != F.col("lb")) & once & _may("a", "b", similar))
    return both.select(F.col("a.t1").alias("u"), F.col("b.t1").alias("v"))


def _differing(a: Column, b: Column) -> Column:
    """In how many parities two sets differ, which have the same number of buckets or one has twice as many."""
    xor = lambda p, q: p.bitwiseXOR(q)
    half = lambda x: F.floor(F.size(x) / 2).cast("int")
    folded = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), xor)
    a, b = F.when(F.size(a) > F.size(b), folded(a)).otherwise(a), F.when(F.size(b) > F.size(a), folded(b)).otherwise(b)
    return F.aggregate(F.zip_with(a, b, xor), F.lit(0), lambda n, x: n + F.bit_count(x))


def _plausible(links: DataFrame, reps: DataFrame, similar: float, files: int) -> DataFrame:
    """Distinct links (u < v) of texts whose sizes and parities allow the similarity."""
    pairs = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = materialise(pairs, "near-pairs", files)  # the shuffles that made them go before the parities are joined
    left, right = (reps.select(F.col("t1").alias(e), F.col("n").alias(f"n{e}"), *[F.col("x")[i].alias(f"x{e}{i}") for i in range(PARITY // 64)]) for e in "uv")
    both = pairs.join(left, "u").join(right, "v")
    differ = sum((F.bit_count(F.col(f"xu{i}").bitwiseXOR(F.col(f"xv{i}"))) for i in range(1, PARITY // 64)), F.bit_count(F.col("xu0").bitwiseXOR(F.col("xv0"))))
    most = F.lit((1 - similar) / (1 + similar)) * (F.col("nu") + F.col("nv")) + F.lit(1e-6)
    sizes = F.least("nu", "nv") >= F.lit(similar) * F.greatest("nu", "nv") - F.lit(1e-6)
    rough = materialise(both.where(sizes & (differ <= most)).select("u", "v", "nu", "nv"), "near-rough", files)
    drop(pairs)
    # two sets that are not twice as large as each other: their numbers of buckets are the same, or one is the other's double
    fine = reps.where(F.size("y") > 0)
    large = rough.where((F.least("nu", "nv") > PARITY) & (2 * F.least("nu", "nv") >= F.greatest("nu", "nv")))
    near = large.join(fine.select(F.col("t1").alias("u"), F.col("y").alias("yu")), "u").join(fine.select(F.col("t1").alias("v"), F.col("y").alias("yv")), "v")
    small = rough.where((F.least("nu", "nv") <= PARITY) | (2 * F.least("nu", "nv") < F.greatest("nu", "nv")))
    return small.select("u", "v").unionByName(near.where(_differing(F.col("yu"), F.col("yv")) <= most).select("u", "v"))


def _verified(links: DataFrame, texts: DataFrame, similar: float, files: int) -> DataFrame:
    """The links that exact Jaccard similarity confirms; texts: (vertex, text), each text once or more."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                h = [s.view(np.int64) for _, s in sets(part.column(1))]
                ends = np.cumsum([0, *map(len, h)]).astype(np.int32)
                yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(ends, np.concatenate(h))], names=["vertex", "h"])

    ends = links.select(F.col("u").alias("vertex")).unionByName(links.select(F.col("v").alias("vertex"))).distinct()
    wanted = texts.join(bounded(ends, KEYS), "vertex", "left_semi")
    shingles = materialise(wanted.mapInArrow(trimming(run), "vertex long, h array<long>").dropDuplicates(["vertex"]), "near-shingles", files)
    own = lambda e: shingles.join(bounded(links.select(F.col(e).alias("vertex")).distinct(), KEYS), "vertex", "left_semi").select(F.col("vertex").alias(e), F.col("h").alias(f"h{e}"))
    left, right = own("u"), own("v")
    both = F.size(F.array_intersect("hu", "hv"))
    exact = links.join(left, "u").join(right, "v").where(both >= F.lit(similar) * (F.size("hu") + F.size("hv") - both) - F.lit(1e-9)).select("u", "v")
    exact = materialise(exact, "near-exact", files)
    drop(shingles)
    return exact


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """`docs` with one row of each group of near copies."""
    cols = docs.columns
    a, b = unused(cols, "k1", "k2")
    whole = quoted(cols)
    plain = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    keyed = docs.withColumns({a: F.xxhash64(*whole), b: F.xxhash64(F.lit(7), *whole)})
    rows = keyed.select(F.col(f"`{id_col}`").alias("id"), F.col(a).alias("k1"), F.col(b).alias("k2"), F.xxhash64(plain).alias("t1"), F.xxhash64(F.lit(7), plain).alias("t2"), plain.alias("text"))
    head = F.struct(F.col("id").isNull().alias("z"), "id", "k1", "k2")
    made = features(rows, similar).groupBy("t1", "t2").agg(F.min(F.struct(head.alias("head"), "f", "x", "y", "p", "n")).alias("r"))
    files = 1 + docs.count() // FILE
    reps = materialise(made.select("t1", "t2", "r.*"), "near-features", files)
    texts = docs.select(F.xxhash64(plain).alias("vertex"), plain.alias("text"))

    table_, shared = _shared(reps, files)
    first = materialise(_plausible(_tries(reps, files).unionByName(_stars(shared, similar)), reps, similar, files), "near-links", files)
    exact = _verified(first, texts, similar, files)
    others = _plausible(_others(shared, components(exact), similar), reps, similar, files).join(first, ["u", "v"], "left_anti")
    others = materialise(others, "near-others", files)
    drop(table_)
    root = components(exact.unionByName(_verified(others, texts, similar, files)))

    named = reps.select("t1", "head").join(root, reps.t1 == root.u, "left").select("head", F.coalesce("v", "t1").alias("root"))
    stay = named.groupBy("root").agg(F.min("head").alias("head")).select("head.k1", "head.k2", F.lit(True).alias("stays"))
    keys = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m")).join(stay, ["k1", "k2"], "left").where("stays IS NULL OR m > 1")
    keys = materialise(keys.select(F.col("k1").alias(a), F.col("k2").alias(b), "stays"), "near-gone", files)
    alone = keyed.join(bounded(keys.select(a, b), KEYS), [a, b], "left_anti")
    equal = keyed.join(bounded(keys.where("stays").select(a, b), KEYS), [a, b], "left_semi").dropDuplicates([a, b])
    return alone.unionByName(equal).select(*whole)
