"""Language identification by nearest centroids.

A text is a vector of hashed byte 1- to 3-grams of its lower-cased letters, weighted by TF-IDF and brought to length
one; document frequencies are those of all training texts. Each language has several centroids, found by spherical
k-means over a bounded sample of its labelled texts (`SAMPLE` different ones a language at most, those of least hash:
the only part that does not read all rows). A text gets the language of the centroid with the largest cosine; where that cosine is lower than nearly all of the language's
own training texts have, the prediction is marked as rejected.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text where nothing was
learned; repeated rows get a row each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlake.llm.common import materialise, table, trimming

DIMS = 1 << 13
#: Labelled texts drawn for a language, and centroids made of them.
SAMPLE, CENTROIDS = 300, 4
#: Share of a language's training texts that may lie farther out than what it accepts.
REJECT = 0.002
PIECE = 1 << 20
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))
_ODD = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text, made piece by piece."""
    out, shift, tail = np.zeros(DIMS, np.int64), np.uint32(32 - 13), np.zeros(0, np.uint32)
    for at in range(0, len(text) + 1, PIECE):
        piece = (" " if not at else "") + text[at : at + PIECE].lower() + (" " if at + PIECE > len(text) else "")
        new = np.frombuffer(piece.encode().translate(_FOLD), np.uint8).astype(np.uint32)
        u = np.concatenate((tail, new))
        two = u[:-1] | (u[1:] << np.uint32(8))
        three = two[:-1] | (u[2:] << np.uint32(16))
        for gram, odd in zip((new, two[max(len(tail) - 1, 0) :], three), _ODD, strict=True):
            out += np.bincount((gram * odd) >> shift, minlength=DIMS)
        tail = u[-2:]
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit rows; starts are the mean's neighbour and then the farthest rows."""
    first = int(np.argmax(x @ x.mean(axis=0)))
    picks, best = [first], x @ x[first]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[picks[-1]])
    c = x[picks]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = unit_rows(new)
    return c


class Model:
    """Centroids (rows), their languages, the IDF weights and the least cosine that each language accepts."""

    def __init__(self, langs: list[str], centroids: np.ndarray, idf: np.ndarray, least: dict[str, float]):
        self.langs, self.centroids, self.idf, self.least = langs, centroids, idf, least

    def vectors(self, texts: list[str]) -> np.ndarray:
        return unit_rows(np.log1p(np.stack([counts(t) for t in texts]).astype(np.float32)) * self.idf)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list = [("und", 0.0, True)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if self.langs and some:
            cos = self.vectors([texts[i] for i in some]) @ self.centroids.T
            for i, j, c in zip(some, np.argmax(cos, axis=1).tolist(), cos.max(axis=1).tolist(), strict=True):
                lang = self.langs[j]
                out[i] = (lang, min(max(float(c), 0.0), 1.0), c < self.least[lang])
        return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learns from rows with a label and a text with a letter."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    spark = labelled.sparkSession
    # copies of a text count once here, so that a language of few texts in many copies has a sample too
    texts = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    n = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}
    if not n:
        return Model([], np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), {})
    shares = spark.createDataFrame([(k, min(1.0, 2 * sample / v)) for k, v in n.items()], "lang string, share double")
    near = texts.join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    least = near.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(F.col("i") <= sample)
    drawn = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(least.select("lang", "h")), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([counts(t).astype("<u4").tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["lang", "vec"])

    table_ = materialise(drawn.mapInArrow(trimming(count), "lang string, vec binary"), "langid-sample", 4)

    def present(batches):
        total, seen = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                total += counts(t) > 0
                seen += 1
        yield pa.record_batch([pa.array([seen]), pa.array([total.tobytes()], pa.binary())], names=["n", "df"])

    total, seen = np.zeros(DIMS, np.int64), 0  # of all training texts: one row of DIMS counts a task
    for p in rows.select("text").mapInArrow(trimming(present), "n long, df binary").toLocalIterator():
        total, seen = total + np.frombuffer(p.df, np.int64), seen + p.n
    idf = (np.log((1 + seen) / (1 + total)) + 1).astype(np.float32)

    def cluster(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit_rows(np.log1p(np.stack([np.frombuffer(v, "<u4") for v in pdf["vec"]]).astype(np.float32)) * idf)
        c = k_means(x[np.lexsort(x[:, :64].T)], centroids).astype(np.float32)
        least = float(np.quantile((x @ c.T).max(axis=1), REJECT)) * 0.9
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": [r.tobytes() for r in c], "least": least})

    made = table_.groupBy("lang").applyInPandas(cluster, "lang string, c binary, least double").collect()  # a few rows a language
    made.sort(key=lambda r: (r["lang"], r["c"]))
    return Model([r["lang"] for r in made], np.stack([np.frombuffer(r["c"], np.float32) for r in made]), idf, {r["lang"]: r["least"] for r in made})


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, `keep` columns, lang_pred, score, rejected)."""
    src = docs.select(F.col(id_col).alias("id"), *keep, F.col(text).cast("string").alias("_text"))
    names = src.columns[:-1]
    last = len(names)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                langs, scores, out = zip(*model.predict(part.column(last).to_pylist()), strict=True)
                yield pa.record_batch([*part.columns[:last], pa.array(langs), pa.array(scores), pa.array([bool(x) for x in out])], names=[*names, "lang_pred", "score", "rejected"])

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    fields = [*src.schema.fields[:last], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    return src.mapInArrow(trimming(run), StructType(fields))


def fold(col: str, n: int, k: int):
    """Whether crc32 of the id as text leaves k by n; false for a null id."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % n == k, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold("doc_id", 3, 1))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs, model, keep=("held_out",)).withColumnRenamed("id", "doc_id")
