import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftlake.llm import token_store as ts
from driftlake.llm.bpe import default_vocabulary
from driftlake.llm.common import new_path

LIB = Tokenizer.from_file(default_vocabulary())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50), st.integers(0, 1 << 28)), max_size=1200))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    e = ts.EliasFano.unpack(ts.EliasFano.build(np.array(values, np.uint64)).pack())
    assert list(e) == values and e.values().tolist() == values
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_is_small():
    v = np.cumsum(np.random.default_rng(1).integers(1, 900, 20_000)).astype(np.uint64)
    assert len(ts.EliasFano.build(v).pack()) * 8 / len(v) < 12
    wide = np.array([0, 5, (1 << 63) + 7], np.uint64)
    assert list(ts.EliasFano.build(wide)) == wide.tolist()


def brute(rows):
    out, at = [], 0
    for doc_id, text in rows:
        ids = [*LIB.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query_matches_the_library(spark, sf):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in ts.op3_token_store(spark, sf).collect())
    assert got == brute(docs)


def test_odd_rows(spark, monkeypatch):
    rows = [(-5, " a  b"), (-5, " a  b"), (3, None), (7, "x " * 3000), (9, ""), (1 << 60, "é\n\nz <|endoftext|> q")]
    df = spark.createDataFrame([*rows, (None, "n")], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS base")
    m = ts.write(df, new_path(spark, "t"), default_vocabulary(), 2)
    got = sorted((tuple(r) for r in ts.read(m, ids=True).collect()), key=lambda r: r[1])
    want = brute([(None, "n"), *rows])
    assert [r[:4] for r in got] == want
    assert [len(r[4]) for r in got] == [w[2] for w in want]
    assert ts.read(ts.write(df.where("false"), new_path(spark, "t"), default_vocabulary(), 2)).count() == 0


PARTS = ["the", " the", "  ", "\n", " \n ", "'s", "don't ", "é", " été", "½3", "x½", "a1b2", "日本", " ", "!!", "<|endoftext|>", ".\n\nY", "\t", " (foo)", "ÃÂ" * 5, "😀", "éx", "_", "ª", "ǅ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=4)), max_size=20))
def test_cached_encoder_is_the_library(parts):
    text = "".join(parts)
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids


ENCODER = ts.LibraryEncoder(default_vocabulary(), 50)
