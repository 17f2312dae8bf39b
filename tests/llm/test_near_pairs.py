"""Pairs that go to verification: no more than sizes and parities allow, and all that are similar."""

import random

import numpy as np
from pyspark.sql import functions as F

from driftlake.llm import near_copies as nc


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def test_large_texts_that_share_a_passage_are_not_verified(spark, monkeypatch):
    rng = random.Random(7)
    passage, seen, verified = words(rng, 60), [], nc._verified

    def counted(links, *rest):
        seen.append(links.count())
        return verified(links, *rest)

    monkeypatch.setattr(nc, "_verified", counted)
    texts = [" ".join(words(rng, 1500) + passage + words(rng, 1500)) for _ in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert nc.keep_one(df).count() == 12
    assert seen == [0, 0]


def test_parities_of_any_two_sizes_bound_what_differs(spark):
    rng = np.random.default_rng(3)
    rows, differ = [], []
    for n, m, common in [(513, 600, 500), (1000, 1030, 1000), (1024, 1025, 900), (2048, 3000, 2048), (700, 1300, 0), (900, 900, 900)]:
        h = rng.integers(0, 1 << 63, n + m - common, np.uint64)
        both = [np.sort(h[:n]), np.sort(h[n - common :])]
        rows.append(tuple(v.tolist() for v in nc.fine_parities(both)))
        differ.append(n + m - 2 * common)
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = [r.d for r in df.select(nc._differing(F.col("a"), F.col("b")).alias("d")).collect()]
    assert all(g <= d and (g - d) % 2 == 0 for g, d in zip(got, differ, strict=True))
    assert got[-1] == 0 and got[-2] > 0.25 * differ[-2]
    assert [len(x) for x in nc.fine_parities([np.arange(512, dtype=np.uint64)])] == [0]


def test_near_copies_across_the_numbers_of_buckets(spark):
    rng = random.Random(8)
    rows = []
    for i, n in enumerate((505, 515, 516, 520, 1000, 1026, 1035, 2050, 2060)):
        base = words(rng, n)
        rows += [(4 * i, " ".join(base)), (4 * i + 1, " ".join(base + words(rng, n // 10))), (4 * i + 2, " ".join(base[n // 10 :])), (4 * i + 3, " ".join(words(rng, n)))]
    kept = {r.doc_id for r in nc.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {x for i in range(9) for x in (4 * i, 4 * i + 3)}
