"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
What a stage does with null texts, repeated rows, empty tables and extra columns is said in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm import bpe, decontaminate, near_copies, quality, suffix_dedup
from driftlake.llm.common import drop_path, new_path, quoted, shuffles_dropped, table, unused

#: Bytes of a passage that counts as repeated: fifty short words.
PASSAGE = 200


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps."""
    return quality.keep(docs, quality.V1)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, similarity of 0.8 or more)."""
    return near_copies.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE bytes or more that occur more than once."""
    return suffix_dedup.without_repeats(docs, PASSAGE)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    (items,) = unused(docs.columns, "items")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), out=items)
    return found.where(F.size(items) == 0).select(*quoted(docs.columns))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, text): the tokens of each document and the text decoded from them."""
    src = docs.select("doc_id", "lang", "source", "text")
    both = bpe.encode(src, bpe.default_vocabulary(), decoded="decoded")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL can't express the suffix, edit-distance and BPE stages; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{i}")
        with shuffles_dropped(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
