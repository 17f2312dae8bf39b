import base64
import hashlib
import io
import random

import pytest
import zstandard

from driftlake.llm import chat, warc
from driftlake.llm.common import new_path


def test_bundle_is_seekable_and_plain_zstandard(tmp_path):
    w = warc.BundleWriter(f"file://{tmp_path}", "b")
    made, want = [], {}
    for i in range(40):
        data = warc.record(str(i), f"http://x/{i}\r\n", bytes(random.Random(i).choices(b"abc", k=20_000)), None, "2020-01-01T00:00:00Z")
        want[str(i)] = data
        made += w.add(str(i), data)
    made += w.end()
    assert len({f for _, _, f, _, _ in made}) > 1
    uri = made[0][1]
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(uri.removeprefix("file://"), "rb").read()), read_across_frames=True).read()
    assert whole == b"".join(want[str(i)] for i in range(40))
    b = warc.Bundle(uri)
    for page, _, frame, at, size in made:
        assert b.record(frame, at, size)[0] == page and b.frame(frame)[at : at + size] == want[page]
    assert len(list(b.records())) == 40
    damaged = want["3"].replace(b"abc", b"abd", 1) if b"abc" in want["3"] else want["3"][:-10] + b"x" * 10
    with pytest.raises(ValueError, match="digest"):
        warc.parse(damaged)


def brute(rows):
    head = {}
    for p, h in rows:
        if p is not None:
            head[h or ""] = max(head.get(h or "", p), p)
    out = []
    for p, h in rows:
        t = (h or "").encode()
        again = (h or "") in head and p != head[h or ""]
        out.append((p, len(t), base64.b32encode(hashlib.sha1(t).digest()).decode(), "revisit" if again else "response", head[h or ""] if again else None))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, warc.op10_warc(spark, sf).collect()), key=str) == brute(pages)


def test_warc_odd_rows(spark):
    rows = [(1, "u", "same"), (5, "u\r\nx", "same"), (None, None, "same"), (7, "v", None), (8, "v", ""), (8, "v", ""), (9, "w", "é\r\n\r\nWARC/1.1\r\n"), (None, "z", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "2 AS sha", "3 AS body", "4 AS head")
    index = warc.write(df, new_path(spark, "w"))
    got = warc.read(index, payloads=True).collect()
    num = lambda x: None if x is None else int(x)
    assert sorted(((num(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, num(r.refers_to)) for r in got), key=str) == brute([(p, h) for p, _, h in rows])
    assert {bytes(r.payload).decode() for r in got if r.payload is not None} == {"same", "", "é\r\n\r\nWARC/1.1\r\n", "alone"}
    one = warc.fetch(index, spark.createDataFrame([("9",)], "page_id string")).collect()
    assert len(one) == 1 and bytes(one[0].payload).decode() == rows[6][2]
    assert warc.read(warc.write(df.where("false"), new_path(spark, "w"))).count() == 0
    few = warc.write(df, new_path(spark, "w"), least=3)
    assert {r.page_id for r in warc.read(few).collect() if r.record_type == "revisit"} == {"1", None}


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|", "<\\\\|x", "a<|b<\\|c|>", "\\<|", "<<|", "<|" * 5])
def test_escape_reverses(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text + "\n\\n")) == text + "\n\\n"


def test_chat_odd_rows(spark):
    probe = chat.PROBE
    rows = [(1, 2, "user", "u2"), (1, 1, "user", None), (1, 1, "assistant", probe), (2, 0, "system", "s"), (2, 1, "user", "hi"), (2, 2, "assistant", "é<\\|x\n"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (3, None, None, ""), (4, 0, "a\nb<|", "t"), (4, 0, "a\nb<|", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS part", "3 AS loss")
    seg = chat.format_chats(df)
    turns = chat.read_chats(seg)
    got = {}
    for r in sorted(turns.collect(), key=lambda r: r.seq):
        got.setdefault(r.conv_id, []).append((r.role, r.text, r.loss_text))
    assert got == {
        1: [("assistant", probe, probe), ("user", "", ""), ("user", "u2", "")],
        2: [("system", "s", ""), ("user", "hi", ""), ("assistant", "é<\\|x\n", "é<\\|x\n")],
        None: [("user", "q", ""), ("assistant", "r", "r")],
        3: [("", "", "")],
        4: [("a\nb<|", "t", ""), ("a\nb<|", "t", "")],
    }
    d = {r.conv_id: r for r in chat.digests(chat.read_chats(seg)).collect()}
    assert {k: r.valid for k, r in d.items()} == {1: False, 2: True, None: True, 3: False, 4: False}
    text = "".join(r.text for r in sorted(seg.where("conv_id = 2").collect(), key=lambda r: (r.seq, r.part)))
    assert d[2].formatted_chars == len(text)
    assert d[2].loss_sha256 == hashlib.sha256("é<\\|x\n".encode()).hexdigest()
    assert chat.digests(chat.read_chats(chat.format_chats(df.where("false")))).count() == 0


def test_bundles_are_read_in_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = []
    for k in range(16):
        w = warc.BundleWriter(f"file://{tmp_path}", f"b{k}")
        rows += w.add(str(k), warc.record(str(k), "http://x/", b"payload", None, "2020-01-01T00:00:00Z")) + w.end()
    index = spark.createDataFrame(rows, warc.INDEX)
    got = warc.read(index).withColumn("task", F.spark_partition_id()).collect()
    assert {r.page_id for r in got} == {str(k) for k in range(16)} and len(got) == 16
    assert len({r.task for r in got}) >= 3  # of four partitions


def test_a_payload_that_most_pages_have(spark):
    rows = [(i, "u", "same" if i % 3 else f"own {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {int(r.page_id): (r.record_type, r.refers_to) for r in warc.read(warc.write(df, new_path(spark, "w"))).collect()}
    assert got == {i: ("response", None) if i % 3 == 0 or i == 299 else ("revisit", "299") for i in range(300)}
