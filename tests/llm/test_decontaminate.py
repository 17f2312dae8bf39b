import random

import numpy as np

from driftlake.llm import decontaminate as dc


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(rng, s, n):
    s = bytearray(s)
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(s))
        if kind == 0:
            s[at] = rng.choice(b"abcdefgh")
        elif kind == 1:
            del s[at]
        else:
            s.insert(at, rng.choice(b"abcdefgh"))
    return bytes(s)


def words(rng, n):
    return b" ".join(bytes(rng.choices(b"etaoinshrdlu", k=rng.randrange(1, 9))) for _ in range(n))


def test_edit_search_is_the_definition():
    rng = random.Random(4)
    for _ in range(200):
        p, t = bytes(rng.choices(b"ab", k=rng.randrange(1, 12))), bytes(rng.choices(b"ab", k=rng.randrange(0, 30)))
        want = brute_distance(p, t)
        assert dc.edit_search(p, t, 3) == min(want, 4)


def test_recall_against_brute_force_and_no_false_match():
    rng = random.Random(9)
    texts = [words(rng, rng.randrange(18, 70)) for _ in range(40)]
    items = dc.Items(list(range(40)), texts)
    docs, want = [], []
    for _ in range(400):
        i = rng.randrange(40)
        k = int(items.budget[i])
        body = words(rng, 60) + b" " + edited(rng, texts[i], rng.randrange(0, k + 3)) + b" " + words(rng, 40)
        docs.append(body)
        want.append(brute_distance(texts[i], body) <= k if False else dc.edit_search(texts[i], body, k) <= k)
        want[-1] = (i, want[-1])
    got = items.find(docs)
    true = [(g, i) for g, (i, w) in zip(got, want, strict=True) if w]
    assert sum(i in g for g, i in true) / len(true) >= 0.99
    for g, (i, w), d in zip(got, want, docs, strict=True):
        assert all(dc.edit_search(texts[x], d, int(items.budget[x])) <= items.budget[x] for x in g)
        assert w or i not in g


def test_short_items_have_their_whole_budget():
    rng = random.Random(5)
    texts = [bytes(rng.choices(b"etaoinshrdlu ", k=n)) for n in range(10, 80)]
    items = dc.Items(list(range(70)), texts)
    assert items.budget.tolist() == [int(n * dc.RATE) for n in range(10, 80)]
    hits = asked = 0
    for i, t in enumerate(texts):
        for _ in range(8):
            body = b"x" * 50 + edited(rng, t, int(items.budget[i])) + b"y" * 50
            hits, asked = hits + (i in items.find([body])[0]), asked + 1
    assert hits / asked >= 0.99


def test_long_items_in_parts(monkeypatch):
    monkeypatch.setattr(dc, "UNIT", 128)
    monkeypatch.setattr(dc, "CELLS", 1 << 12)
    rng = random.Random(8)
    texts = [words(rng, 20), words(rng, 400), words(rng, 90)]
    items = dc.Items([0, 1, 2], texts)
    docs = [words(rng, 90) + b" " + edited(rng, t, int(len(t) * 0.045)) + b" " + words(rng, 90) for t in texts] + [texts[1][: len(texts[1]) // 2]]
    assert items.find(docs) == [[0], [1], [2], []]


def test_chunks_do_not_matter(monkeypatch):
    rng = random.Random(3)
    texts = [words(rng, 30) for _ in range(5)]
    items = dc.Items(list(range(5)), texts)
    docs = [words(rng, 200) + b" " + texts[i % 5] + b" " + words(rng, 100) for i in range(10)] + [b"", texts[0], texts[1][:-1]]
    want = items.find(docs)
    assert want[:10] == [[i % 5] for i in range(10)] and want[10:] == [[], [0], [1]]
    monkeypatch.setattr(dc, "CHUNK", 97)
    assert items.find(docs) == want


def test_odd_rows(spark, monkeypatch):
    item = "Quite a long passage of a benchmark that nobody else would write down by chance."
    items = spark.createDataFrame([(7, item), (3, None), (4, "short"), (7, item), (9, "exactly sixteen!"), (11, "q-9"), (12, " \n ")], "item_id long, text string")
    rows = [(1, f"x {item.upper()} y"), (2, None), (2, ""), (None, item.replace(" ", "\n  ")), (5, "clean"), (6, "so exactly  sixteen! it is"), (6, "so exactly sixteem! it is"), (8, "what a Q-9 is, in short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' AS item_ids", "1 AS item_id")
    got = dc.matches(df, items).collect()
    assert [r.item_ids for r in got] == [[7], [], [], [7], [], [9], [], [4, 11]]
    assert got[0].item_id == 1
    assert all(r.item_ids == [] for r in dc.matches(df, items.where("false")).collect())
    assert dc.matches(df.where("false"), items).count() == 0
    monkeypatch.setattr(dc, "BLOCK", 1)
    assert [r.item_ids for r in dc.matches(df, items).collect()] == [[7], [], [], [7], [], [9], [], [4, 11]]


def test_query_matches_brute_force(spark, sf):
    items = [(r.item_id, dc.normalised(r.text.encode())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r.item_ids for r in dc.op6_decontaminate(spark, sf).collect()}
    hits = 0
    for d in docs:
        t = dc.normalised((d.text or "").encode())
        budget = lambda x: int(len(x) * dc.RATE)
        want = [i for i, x in items if dc.edit_search(x, t, budget(x)) <= budget(x)]
        assert got[d.doc_id] == want
        hits += bool(want)
    assert hits and len(got) == len(docs)
    assert np.isfinite(hits)


def test_case_is_folded_over_all_scripts(spark):
    rows = [
        (1, "El señor Núñez comió piñón y jamón en Córdoba mañana según canción añeja y él volvió sin razón aquí"),
        (2, "Съешь же ещё этих мягких французских булок да выпей чаю, сказал старый учитель"),
        (3, "Ο γρήγορος σκύλος πηδά πάνω από τους τεμπέληδες φίλους στους δρόμους της πόλης"),
        (4, "Die große Straße führt außen am weißen Schloß vorbei, heißt es bei den Fußgängern"),
    ]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = spark.createDataFrame([(i, f"so: {t.upper()} -- end") for i, t in rows], "doc_id long, text string")
    assert {r.doc_id: r.item_ids for r in dc.matches(docs, items).collect()} == {i: [i] for i, _ in rows}
    back = spark.createDataFrame([(i, t.upper()) for i, t in rows], "item_id long, text string")
    lower = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.item_ids for r in dc.matches(lower, back).collect()} == {i: [i] for i, _ in rows}
    assert dc.normalised(b"A\xff\xc3 \xc3\x91") == b"a\xff\xc3 \xc3\xb1"
