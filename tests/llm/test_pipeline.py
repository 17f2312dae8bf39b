import random

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from driftlake.llm import bpe, decontaminate, quality, suffix_dedup
from driftlake.llm.quality import MEASURE_SQL
from driftlake.llm.common import new_path

LIB = Tokenizer.from_file(bpe.default_vocabulary())


def jaccard(a, b):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Input and output rows of each stage on the given tables."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, f in cp.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        path = new_path(spark, "t")
        f(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        assert len({r.doc_id for r in rows}) == len(rows)
        out.append((before, {r.doc_id: r for r in rows}))
    return out


def test_quality_stage(stages, sf):
    before, after = stages[0]
    con = duckdb.connect()
    kept = con.sql(MEASURE_SQL.replace("{docs}", f"'{sf}/documents.parquet'") + " SELECT doc_id FROM led WHERE fail_bits & 63 = 0").fetchall()
    assert {x[0] for x in kept} == set(after) < set(before)
    assert all(after[i] == before[i] for i in after)


def test_near_dedup_stage(stages):
    before, after = stages[1]
    ids = sorted(before)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, i in enumerate(ids):
        for j in ids[:a]:
            if jaccard(before[i].text, before[j].text) >= 0.8:
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    want = {find(i) for i in ids}
    assert want <= set(after) and len(set(after) - want) <= 1
    assert len(after) < len(before) and all(after[i] == before[i] for i in after)


def test_suffix_stage(stages):
    before, after = stages[2]
    ids = sorted(before)
    data = [(before[i].text or "").encode() for i in ids]
    hit = 0
    for i, t, cut in zip(ids, data, suffix_dedup.brute_removed(data, cp.PASSAGE), strict=True):
        left, at = b"", 0
        for a, b in cut:
            left, at = left + t[at:a], b
        text = (left + t[at:]).decode("utf-8", "ignore")
        assert after[i].text == text and after[i].n_chars == len(text)
        hit += bool(cut)
    assert hit


def test_decontamination_stage(stages, spark, sf):
    before, after = stages[3]
    items = [decontaminate.normalised(r.text.encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    k = lambda x: int(len(x) * decontaminate.RATE)
    for i, r in before.items():
        t = decontaminate.normalised((r.text or "").encode())
        assert (i in after) == (not any(decontaminate.edit_search(x, t, k(x)) <= k(x) for x in items))
    assert len(after) < len(before)


def test_bpe_stage(stages):
    before, after = stages[4]
    assert set(before) == set(after)
    for i, r in after.items():
        ids = LIB.encode(before[i].text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.text == (before[i].text or "")


def test_run_is_all_stages(stages, spark, sf):
    rows = cp.run(spark, sf).collect()
    assert {r.doc_id: r for r in rows} == stages[-1][1]


def test_stages_on_odd_rows(spark, sf, tmp_path):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(120))
    rows = [(1, text, "en", "a", 5), (None, text[::-1], None, None, None), (1, text, "en", "a", 5), (3, None, "en", "b", 0), (4, "", "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.where("false")):
        now = some
        for _, f in cp.STAGES:
            path = new_path(spark, "t")
            f(spark, now, sf).write.parquet(path)
            now = spark.read.parquet(path)
        assert now.count() == (2 if some is docs else 0)
    assert np.array_equal(quality.V1.mask, 63)


def test_stages_keep_columns_of_any_name(spark, sf, tmp_path):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(120)) for _ in range(3)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    odd = {"n_words": "own", "kept": "own", "fail_bits": "own", "items": "own", "k1": "own", "plain": "own", "a.b": "own", "found": "own", "_all": "own"}
    docs = docs.selectExpr("*", *[f"'{v}' AS `{k}`" for k, v in odd.items()])
    now = docs
    for _, f in cp.STAGES[:-1]:
        path = new_path(spark, "t")
        f(spark, now, sf).write.parquet(path)
        now = spark.read.parquet(path)
        assert now.columns == docs.columns
    assert sorted(r.doc_id for r in now.collect()) == [0, 1, 2] and all(r[k] == v for r in now.collect() for k, v in odd.items())


def test_quality_ledger_odd_rows_and_ablation(spark):
    rows = [(1, None), (2, ""), (3, "a b c " * 60), (3, "a b c " * 60), (4, " ".join(f"w{i}" for i in range(60)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS n_words", "'x' AS fail_bits", "1 AS kept", "2 AS n_lines")
    led = quality.apply_policy(quality.ledger(df))
    got = [(r.doc_id, r.n_words, r.n_repeat_words, r.kept) for r in led.collect()]
    assert got == [(1, 0, 0, False), (2, 0, 0, False), (3, 180, 180, False), (3, 180, 180, False), (4, 60, 0, True)]
    abl = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablation(led).collect()}
    assert abl["too_few_words"] == (2, 2, 3) and abl["repeated_windows"][0] == 2 and abl["exclamations"] == (0, 0, 1)
    assert quality.ledger(df.where("false")).count() == 0
