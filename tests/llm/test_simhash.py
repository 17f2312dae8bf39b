import random

import numpy as np
import pytest
import xxhash

from driftlake.llm import components, simhash


def brute_fp(text, k=3):
    words = [w for w in (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """{id: least reachable id} of [(id, fp)]."""
    up = {i: i for i, _ in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(fps):
        for j, y in fps[:a]:
            if (x ^ y).bit_count() <= 2:
                a1, b1 = find(i), find(j)
                up[max(a1, b1)] = min(a1, b1)
    return {i: find(i) for i, _ in fps}


def test_fingerprint_matches_definition(monkeypatch):
    rng = random.Random(1)
    for _ in range(50):
        t = "".join(rng.choice(["A", "b\n", "é ", "Zz\x0b", " ", " x", "c d"]) for _ in range(rng.randrange(0, 60)))
        assert simhash.fingerprint(t.encode()) == brute_fp(t), repr(t)
    long = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 9) for _ in range(2000))
    whole = simhash.fingerprint(long.encode())
    monkeypatch.setattr(simhash, "PIECE", 100)
    monkeypatch.setattr(simhash.word_pieces, "__defaults__", (100,))
    assert simhash.fingerprint(long.encode()) == whole == brute_fp(long)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("group", [4096, 3])
def test_links_span_the_brute_force_pieces(spark, group):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    vals = set(seeds)
    for s in seeds[:6]:
        for _ in range(40):
            x = s
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
            vals.add(x)
    vals = sorted(vals | {0, 1, (1 << 64) - 1, 1 << 63})
    signed = [int(np.uint64(v).view(np.int64)) for v in vals]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.hamming_links(df, 2, group).collect()
    for a, b in links:
        assert (a ^ b).bit_count() <= 2 if a >= 0 and b >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    got = {r.u: r.v for r in components.components(spark.createDataFrame([tuple(r) for r in links], "u long, v long")).collect()}
    want = brute_components([(s, s & (1 << 64) - 1) for s in sorted(signed)])
    assert {s: got.get(s, s) for s in signed} == want


def test_odd_rows(spark):
    rows = [(3, "a b c d e"), (1, "A B C D E"), (2, None), (5, ""), (None, "a b c d e"), (3, "a b c d e"), (7, "x" * 100_000), (8, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS fp", "2 AS component", "3 AS id")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    assert {(r.id, r.component) for r in out} == {(3, 1), (1, 1), (2, 2), (5, 2), (None, 1), (7, 7), (8, 8)}
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_query_matches_brute_force(spark, sf):
    out = simhash.op2_simhash(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = sorted((r.doc_id, brute_fp(r.text)) for r in docs)
    want = brute_components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{f:016x}", want[i]) for i, f in fps}
