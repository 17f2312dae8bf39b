import hashlib
import random

import pytest

from driftlake.llm import suffix_dedup as sd


def test_loser_tree_sorts_and_counts_shared_prefixes():
    rng = random.Random(1)
    for _ in range(60):
        runs = []
        for i in range(rng.randrange(1, 9)):
            e = sorted({(bytes(rng.choices(b"ab", k=rng.randrange(0, 12))), bytes(rng.choices(b"xy", k=2))) for _ in range(rng.randrange(0, 30))})
            runs.append([(*x, 1, i, 0) for x in e])
        tree = sd.LoserTree([sd.unpack_run(sd.pack_run(r)) for r in runs])
        got = list(tree)
        want = sorted((r, le) for run in runs for r, le, *_ in run)
        assert [(e[1], e[2]) for _, e in got] == want
        last = b""
        for h, e in got:
            assert h == sd.shared(last, e[1])
            last = e[1]


def texts(rng):
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 9)))
    passage = lambda n: " ".join(word() for _ in range(n))
    shared = [passage(n) for n in (60, 80, 120, 75, 77)]
    out = []
    for _ in range(60):
        parts = [passage(rng.randrange(0, 120)) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 60)
            parts.insert(rng.randrange(len(parts) + 1), s[a : len(s) - rng.randrange(0, 60)] if rng.random() < 0.6 else s)
        out.append(" ".join(parts))
    out += [out[3]] * 3 + [out[5][:-30] + "!", "?" + out[5][20:], "=" * 1500, "ab" * 700, "ab" * 300, "x" * 399, "x" * 400, "y" * 401, "", shared[0] + shared[0]]
    for _ in range(12):  # the edges of one passage, many ways
        s = shared[2]
        a, b = rng.randrange(0, 40), rng.randrange(0, 40)
        out.append(word() + s[a : len(s) - b] + word())
    return out


def check(spark, ts, length=400, **more):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "doc_id long, text string")
    got = {r.id: ([(s.start, s.end) for s in r.spans], bytes(r.kept), r.n_bytes) for r in sd.repeats(df.repartition(5), length=length, **more).collect()}
    data = [(t or "").encode() for t in ts]
    for i, cut in enumerate(sd.brute_removed(data, length)):
        assert got[i][0] == cut, (i, got[i][0], cut)
        left, at = b"", 0
        for a, b in cut:
            left, at = left + data[i][at:a], b
        assert got[i][1] == left + data[i][at:] and got[i][2] == len(data[i])


@pytest.mark.parametrize(("seed", "hot"), [(1, 4096), (2, 4096), (3, 2)])
def test_removes_what_the_definition_removes(spark, seed, hot):
    check(spark, texts(random.Random(seed)), hot=hot)


def test_other_length_and_long_texts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(1, 9)))
    far = " ".join(word() for _ in range(600_000))  # longer than two segments
    check(spark, [*texts(rng)[:40], far, "x" + far[1_048_000:1_049_500] + "y", far[5:5000]], length=200)


def test_cut_texts_keep_their_columns(spark):
    rows = [(1, "é" * 300, None, 300), (2, "a" + "é" * 250, "de", 251), (2, None, "fr", None), (3, "clean", "en", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").select("doc_id", "text", "lang", "n_chars")
    out = sd.without_repeats(df, 200)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "", None, 0), (2, "a", "de", 1), (2, None, "fr", None), (3, "clean", "en", 5)], key=str)


def test_odd_rows(spark, monkeypatch):
    long = "abc def " * 100
    rows = [(1, long), (1, long), (None, long + "x"), (4, None), (5, ""), (6, "z" * 399)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS k", "3 AS nb")
    got = sorted(((r.id is None, r.id or 0, r.n_bytes, len(r.kept)) for r in sd.repeats(df).collect()))
    assert got == [(False, 1, 800, 0), (False, 1, 800, 0), (False, 4, 0, 0), (False, 5, 0, 0), (False, 6, 399, 399), (True, 0, 801, 1)]
    assert sd.repeats(df.where("false")).count() == 0


def test_query_matches_the_definition(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in sd.op1_suffix_dedup(spark, sf).collect()}
    data = [(t or "").encode() for _, t in docs]
    for (i, _), t, cut in zip(docs, data, sd.brute_removed(data), strict=True):
        left, at = b"", 0
        for a, b in cut:
            left, at = left + t[at:a], b
        left += t[at:]
        assert got[i] == (len(t), len(t) - len(left), len(cut), hashlib.sha256(left).hexdigest())
