import math
import zlib
from collections import Counter

import numpy as np

from driftlake.llm import langid, lm


def test_languages_of_held_out_documents(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = langid.op4_language_id(spark, sf).collect()
    assert len(out) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_counts_do_not_depend_on_pieces(monkeypatch):
    texts = ["", "a", "Straße über alles", "the cat and the dog " * 30]
    want = [langid.counts(t) for t in texts]
    monkeypatch.setattr(langid, "PIECE", 5)
    assert all(np.array_equal(langid.counts(t), w) for t, w in zip(texts, want, strict=True))
    u = (" " + texts[3].lower() + " ").encode()
    assert want[3].sum() == 3 * len(u) - 3


def test_prediction_is_the_nearest_centroid(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    assert len(model.langs) <= 4 * docs.select("lang").distinct().count()
    for r, d in zip(langid.predict(docs.orderBy("doc_id").limit(60), model).orderBy("id").collect(), docs.orderBy("doc_id").limit(60).collect(), strict=True):
        v = [math.log1p(c) * i for c, i in zip(langid.counts(d.text).tolist(), model.idf.tolist(), strict=True)]
        norm = math.sqrt(sum(x * x for x in v))
        cos = [sum(x * y for x, y in zip(v, c.tolist(), strict=True)) / norm for c in model.centroids]
        assert math.isclose(r.score, max(cos), rel_tol=1e-4) and r.lang_pred == model.langs[cos.index(max(cos))]


def test_sample_is_bounded_and_holds_every_language(spark):
    rows = [(i, "le chat et le chien", "fr") for i in range(300)] + [(i, f"the dog number {i} and his friend", "en") for i in range(300, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert set(langid.fit(df, sample=20).langs) == {"en", "fr"}


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !!", "de"), (None, "the end", None), (1, "the cat and the dog", "en"), (6, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "'x' AS lang_pred", "0 AS score")
    model = langid.fit(df)
    got = langid.predict(df, model).collect()
    assert len(got) == 7
    assert [r.lang_pred for r in got] == ["en", "de", "und", "und", "en", "en", "und"]
    none = langid.fit(df.where("false"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.where("false"), model).count() == 0
    far = langid.predict(spark.createDataFrame([(1, "ｚｚ щщ ъъ жжж")], "doc_id long, text string"), model).first()
    assert far.rejected and far.lang_pred in ("en", "de")


def brute_log_marginal(lat, word):
    s = "▁" + word
    a = [0.0] + [-math.inf] * len(s)
    for j in range(1, len(s) + 1):
        p = 0.0
        for i in range(j):
            if s[i:j] in lat.ids:
                p += math.exp(a[i] + lat.w[lat.ids[s[i:j]]])
            elif j == i + 1:
                p += math.exp(a[i] + len(s[i:j].encode()) * lat.byte)
        a[j] = math.log(p) if p else -math.inf
    return a[-1] + lat.log_stop


def test_lattice_sums_all_segmentations():
    names, w = lm.load_pieces(lm.default_pieces())
    lat = lm.Lattice(names, w + math.log(0.5), 0.3)
    words = ["the", "a", "thanble", "éauxment", "日本語x", "😀", "internationalisation", "q" * 30, "", "x" * 47]
    got = lat.log_marginals(words)
    assert np.allclose(got, [brute_log_marginal(lat, x) for x in words], rtol=1e-9)
    long = "abcthe" * 12
    assert math.isclose(lat._long("▁" + long), brute_log_marginal(lat, long), rel_tol=1e-9)
    e = lat.expected(["the", "the", "ab"], np.array([2, 1, 1]))
    assert e[lat.ids["▁the"]] > 1 and (e >= 0).all()


def brute_base(rows):
    train = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*(t or "").encode().lower().split(), "END"])
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in rows:
        tok = [*(t or "").encode().lower().split(), "END"]
        out.append((i, len(tok), sum(train[x] > 0 for x in tok), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in tok)))
    return out


def close(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert tuple(g[:4]) == tuple(w[:4]) and math.isclose(g[4], w[4], rel_tol=1e-9, abs_tol=1e-9)


def test_scores_match_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    out = lm.op7_lm_score(spark, sf).collect()
    close([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out], brute_base(docs))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in out)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)


def brute_lattice(words, names, log_w, byte, rounds, prior_weights):
    """Plain forward-backward over all spans: EM over counted words, then (weights, stop)."""
    ids = {p: i for i, p in enumerate(names)}
    n_words, stop, w = sum(words.values()), 0.3, log_w.copy()
    spans = lambda s, v: [(i, j, ids.get(s[i:j]), v[ids[s[i:j]]] if s[i:j] in ids else len(s[i:j].encode()) * byte) for j in range(1, len(s) + 1) for i in range(j) if s[i:j] in ids or j == i + 1]
    for _ in range(rounds):
        v, uses = w + math.log(1 - lm.BYTES) + math.log(1 - stop), np.exp(prior_weights) * lm.PRIOR
        for word, c in words.items():
            s = "▁" + word
            arcs = spans(s, v)
            a, b = [1.0] + [0.0] * len(s), [0.0] * len(s) + [1.0]
            for i, j, _, x in arcs:
                a[j] += a[i] * math.exp(x)
            for i, j, _, x in reversed(arcs):
                b[i] += b[j] * math.exp(x)
            for i, j, p, x in arcs:
                if p is not None:
                    uses[p] += c * a[i] * math.exp(x) * b[j] / a[-1]
        w = np.log(uses / uses.sum())
        stop = (n_words + 0.3 * lm.PRIOR) / (n_words + 0.3 * lm.PRIOR + uses.sum())
    v = w + math.log(1 - lm.BYTES) + math.log(1 - stop)

    def log_p(word):
        s, a = "▁" + word, None
        a = [1.0] + [0.0] * len(s)
        for i, j, _, x in spans(s, v):
            a[j] += a[i] * math.exp(x)
        return math.log(a[-1]) + math.log(stop)

    return log_p


def test_score_is_the_brute_force_marginal(spark):
    rows = [(1, "the internationalisation of the thanble"), (9, "zebra the éaux 日本"), (16, "held out thanbles the"), (3, "q" * 60 + " the"), (4, None), (5, "abcthe" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("out", langid.fold("doc_id", 7, 2))
    got = {r.id: r for r in lm.score(df, "out").collect()}
    names, prior = lm.load_pieces(lm.default_pieces())
    train = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    log_p = brute_lattice(Counter(w for t in train for w in t.split()), names, prior, math.log(lm.BYTES / 256), lm.ROUNDS, prior)
    n, ends = sum(len(t.split()) + 1 for t in train), len(train)
    for i, t in rows:
        want = sum(log_p(w) + math.log((n - ends + 1) / (n + 2)) for w in (t or "").split()) + math.log((ends + 1) / (n + 2))
        assert math.isclose(got[i].score, want / math.log(10), rel_tol=1e-9)


def test_learning_beats_the_existing_scores(spark, sf, monkeypatch):
    held = lambda: sum(r.score for r in lm.op7_lm_score(spark, sf).collect() if r.held_out)
    learned = held()
    monkeypatch.setattr(lm, "PRIOR", 1e12)
    assert learned > held()


def test_lm_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, "The the \x0b cat"), (9, None), (9, None), (None, "dog"), (16, "x" * 5000), (17, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS chunk", "3 AS held", "4 AS word")
    got = lm.score(df.withColumn("out", langid.fold("doc_id", 7, 2)), "out").collect()
    close([(r.id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], brute_base(rows))
    assert lm.score(df.where("false").withColumn("out", F.lit(True)), "out").count() == 0
    none = lm.score(df.withColumn("out", F.lit(True)), "out").collect()
    assert len(none) == 6 and all(r.base_score == 0 and math.isfinite(r.score) for r in none)
