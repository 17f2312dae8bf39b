import random

import numpy as np

from driftlake.llm import near_copies as nc


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def corpus(rng):
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 8)))
    out = []
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(60, 400))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(0, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 40)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out


def test_keeps_one_of_each_group(spark):
    rng = random.Random(2)
    texts = corpus(rng)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in nc.keep_one(df).collect()}
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    want = {find(i) for i in range(len(texts))}
    assert want <= kept  # no clean document goes
    assert len(kept - want) <= 0.05 * (len(texts) - len(want))


def test_large_group_of_copies_and_near_copies(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(base)) for i in range(100, 900)]
    for i in range(700):
        w = list(base)
        w[rng.randrange(200)] = f"x{i}"
        rows.append((i + 1000, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert [r.doc_id for r in nc.keep_one(df).collect()] == [100]


def test_sets_are_those_of_the_words(monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    texts = [None, "", " \n", "A b", "a  B\tc d", "a b c d e f a b c d e", "É é x\x85y z", " ".join(f"w{rng.randrange(90)}" for _ in range(3000))]
    texts += ["".join(rng.choices("aB \n", k=rng.randrange(60))) for _ in range(200)]
    plain = list(nc.sets(pa.array(texts)))
    monkeypatch.setattr(nc, "SEGMENT", 16)
    for t, (w, s), (w2, s2) in zip(texts, plain, nc.sets(pa.array(texts)), strict=True):
        words = (t or "").encode().lower().split()
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}
        assert (len(w), len(s)) == (len(set(words)), len(grams))
        assert np.array_equal(w, w2) and np.array_equal(s, s2)
    same = list(nc.sets(pa.array(["one two three four five six", "ONE two  three four\nfive seven"])))
    assert len(np.intersect1d(same[0][1], same[1][1])) == 1


def test_parities_never_say_more_than_what_differs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900), np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.8], rng.integers(0, 1 << 63, rng.integers(1, 300), np.uint64))))
        x, y = nc.parities([a, b])
        assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= len(np.setxor1d(a, b))


def test_odd_rows(spark):
    rows = [(2, None, "a"), (1, "", "b"), (None, "same text here", "c"), (5, "same text here", "d"), (5, "same text here", "d"), (6, "x", None), (7, "y " * 20000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS k1", "2 AS t1", "3 AS _k3")
    out = nc.keep_one(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.lang) for r in out.collect()) == [(1, "b"), (5, "d"), (6, None), (7, "e")] or {r.doc_id for r in out.collect()} == {1, 5, 6, 7}
    assert nc.keep_one(df.where("false")).count() == 0


def same_as_brute_force(spark, texts):
    """Rows that stay, held against the components of all pairs; the number of rows that stay."""
    def grams(t):
        w = t.split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    sets, up = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(x & y)
            if both * 9 >= 4 * (len(x) + len(y)):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r.doc_id for r in nc.keep_one(df).collect())
    assert kept == [i for i in range(len(texts)) if find(i) == i]
    return len(kept)


def fresh(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def swapped(rng, words, n):
    """`words` with n pairs of neighbours changed round: other shingles, the same set of words."""
    w = list(words)
    for i in rng.sample(range(0, len(w) - 1, 8), n):
        w[i], w[i + 1] = w[i + 1], w[i]
    return w


def test_families_around_a_base(spark):
    rng, texts = random.Random(11), []
    for size in (20, 200, 1000):
        base = fresh(rng, 300)
        texts.append(" ".join(base))
        for _ in range(size):
            w = list(base)
            for k in rng.sample(range(300), 4):
                w[k] = fresh(rng, 1)[0]
            texts.append(" ".join(w))
    assert same_as_brute_force(spark, texts) < 20


def test_blocks_added_removed_and_replaced(spark):
    rng, texts = random.Random(12), []
    for i in range(200):
        base, n = fresh(rng, 300), rng.randrange(25, 66)
        texts += [" ".join(base), " ".join([base + fresh(rng, n), fresh(rng, n) + base, base[n:], base[: -(n // 2)] + fresh(rng, n // 2)][i % 4])]
    assert 200 <= same_as_brute_force(spark, texts) < 230


def test_texts_near_a_member_that_is_no_head(spark, monkeypatch):
    monkeypatch.setattr(nc, "TILE", 4)
    rng, texts = random.Random(13), []
    for _ in range(40):
        base = fresh(rng, 300)
        texts += [" ".join(swapped(rng, base, 1)) for _ in range(8)]  # all have the words of `base`
        at = rng.sample(range(0, 296, 8), 8)
        member, far = list(base), None
        for k, i in enumerate(at):
            member[i], member[i + 1] = member[i + 1], member[i]
            if k == 3:
                texts.append(" ".join(member))
        far = list(member)
        far[at[0] + 4] = fresh(rng, 1)[0]
        texts.append(" ".join(far))
    same_as_brute_force(spark, texts)


def test_twins_in_a_group_of_one_set_of_words(spark):
    rng, texts = random.Random(14), []
    base = fresh(rng, 300)
    for _ in range(300):
        one = swapped(rng, base, 4)
        texts += [" ".join(one), " ".join(swapped(rng, one, 1))]
    same_as_brute_force(spark, texts)
