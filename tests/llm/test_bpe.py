import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftlake.llm import bpe

PATH = bpe.default_vocabulary()
LIB = Tokenizer.from_file(PATH)
ENCODER, DECODER = bpe.coder(PATH)
PIECES = ["the", " the", "  ", "\n", " \n ", "'s", "'ll", "don't", "é", "日本", " ", " ", "123", " 1", "!!", "<|endoftext|>", "<|endof", " <|endoftext|> ", "\t", "a" * 70, "-" * 130, "ÃÂ" * 20, "😀", "́", "\x85", "_", "¼", "\x1c"]


def lib(text):
    return LIB.encode(text, add_special_tokens=False).ids


def streamed(text, rng, most=7):
    out, at = [], 0
    while at < len(text):
        n = rng.randrange(1, most)
        out += ENCODER.feed(text[at : at + n])
        at += n
    out += ENCODER.finish()
    return np.frombuffer(b"".join(out), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=20), st.integers(0, 9))
def test_same_ids_as_the_library(parts, seed):
    text = "".join(parts)
    ids = np.frombuffer(ENCODER.encode(text), "<u4")
    assert ids.tolist() == lib(text)
    assert streamed(text, random.Random(seed)) == ids.tolist()
    assert DECODER.decode(ids) == LIB.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("unit", ["a", "ab", " ", "\n", "the", "-", "1", "é", "ÃÂ", " x", "'s"])
def test_constant_memory_on_runs(unit, monkeypatch):
    text = "x " + unit * (30_000 // len(unit)) + " end"
    want = lib(text)
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == want
    assert streamed(text, random.Random(3), 3000) == want


def test_lookahead_is_sufficient():
    rng = random.Random(2)
    vocab = ENCODER.vocab
    assert 0 < vocab.lookahead < 2000
    for _ in range(300):
        data = b"".join(vocab.bytes_of[rng.randrange(50000)] for _ in range(rng.randrange(2, 400)))
        core = bpe._Core(vocab)
        core.full = vocab.lookahead + 1
        got = [*core.feed(data), *core.finish()]
        assert got == vocab.merge(data)


def test_odd_rows_and_columns(spark):
    rows = [(1, None, 5), (2, "", 6), (2, "", 6), (None, "a  b" * 1000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long").withColumn("decoded", df_lit())
    out = bpe.decode(bpe.encode(df, PATH), PATH)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = out.collect()
    assert len(got) == 4 and all(r.decoded == (r.text or "") for r in got)
    assert got[3].ids == lib(rows[3][1])
    assert bpe.encode(df.where("false"), PATH).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_query_matches_the_library(spark, sf):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in bpe.op8_bpe(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = lib(d.text or "")
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()
