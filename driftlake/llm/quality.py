"""Quality rules as a bitmask ledger.

Each rule is evaluated once per document. The ledger keeps the measurements and one long of failure bits;
a policy is a named, versioned mask over these bits, so a new policy, or an ablation of an old one, never
reads a text again. Everything here is a built-in expression of Spark: no Python runs on the executors.

Defined results: a null text has no words and no symbols; an empty text is the same; repeated rows get a row
each; an empty table gives an empty ledger; a document keeps all its own columns, and a column whose name the
ledger also uses is replaced by the ledger's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.llm.common import WS, WS_CHARS, quoted, table, unused

#: Bit of each rule in the ledger. Bits are never reused: a retired rule leaves a hole.
RULES = {
    "too_few_words": 0,
    "repeated_windows": 1,
    "symbol_heavy": 2,
    "duplicate_lines": 3,
    "word_length": 4,
    "exclamations": 5,
}


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document is kept if none of these rules failed."""

    name: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r] for r in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
V1 = Policy("v1", tuple(RULES))

#: Measurements of the ledger.
MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs")
#: Words of a document whose position fits beside the hash of its window in one long.
_INDEX_BITS = 24
_LOW = (1 << _INDEX_BITS) - 1


def _window(words: str, i: Column) -> tuple[Column, Column, Column]:
    return F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)


def measurements(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_bangs.

    3-word windows are packed as (hash, position) into longs, which sort without a comparator; windows that share a
    hash with a neighbour are then compared by their words, so n_repeat_words is exact.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    t_, trim_, words_, packed_, suspects_, grams_, lines_ = own = unused(docs.columns, "t", "trim", "words", "packed", "suspects", "grams", "lines")
    trimmed = F.btrim(t, F.lit(WS_CHARS))
    df = docs.drop(*[c for c in MEASURED if c in docs.columns])
    df = df.withColumn(t_, t).withColumn(trim_, trimmed)
    df = df.withColumn(words_, F.when(F.col(trim_) == "", F.array().cast("array<string>")).otherwise(F.split(trim_, WS)))
    df = df.withColumn("n_words", F.size(words_).cast("long"))
    last = (F.col("n_words") - 3).cast("int")
    packed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*_window(words_, i)).bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long")))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(packed_, F.when(F.col("n_words") >= 3, F.sort_array(packed)).otherwise(none))
    high = lambda x: x.bitwiseAND(F.lit(~_LOW))
    same = lambda x, k: F.coalesce(high(x) == high(F.get(packed_, k - 1)), F.lit(False)) | F.coalesce(high(x) == high(F.get(packed_, k + 1)), F.lit(False))
    suspects = F.when(F.col("n_words") <= _LOW, F.transform(F.filter(packed_, same), lambda x: x.bitwiseAND(F.lit(_LOW)).cast("int"))).otherwise(F.sequence(F.lit(0), last))
    df = df.withColumn(suspects_, F.when(F.size(packed_) == 0, F.array().cast("array<int>")).otherwise(suspects))
    df = df.withColumn(grams_, F.when(F.size(suspects_) < 2, F.lit(None)).otherwise(F.sort_array(F.transform(suspects_, lambda i: F.struct(F.concat_ws(" ", *_window(words_, i)).alias("t"), i.alias("i"))))))
    twin = lambda y, k: F.coalesce(y["t"] == F.get(grams_, k - 1)["t"], F.lit(False)) | F.coalesce(y["t"] == F.get(grams_, k + 1)["t"], F.lit(False))
    covered = F.array_distinct(F.flatten(F.transform(F.filter(grams_, twin), lambda y: F.array(y["i"], y["i"] + 1, y["i"] + 2))))
    df = df.withColumn("n_repeat_words", F.when(F.col(grams_).isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long"))
    df = df.withColumn("word_chars", F.length(F.translate(t_, WS_CHARS, "")).cast("long"))
    df = df.withColumn("n_symbols", (F.length(t_) - F.length(F.translate(t_, "#*$%&|<>", ""))).cast("long"))
    df = df.withColumn("n_bangs", (F.length(t_) - F.length(F.replace(t_, F.lit("!"), F.lit("")))).cast("long"))
    df = df.withColumn(lines_, F.filter(F.split(t_, "\n"), lambda x: F.length(F.translate(x, WS_CHARS, "")) > 0))
    df = df.withColumn("n_lines", F.size(lines_).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long"))
    return df.drop(*own)


def _failed() -> dict[str, Column]:
    c = F.col
    return {
        "too_few_words": c("n_words") < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbol_heavy": 100 * c("n_symbols") > 30 * c("n_words"),
        "duplicate_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
        "exclamations": 100 * c("n_bangs") > 60 * c("n_words"),
    }


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the measurements and `fail_bits`: bit RULES[r] is set where rule r failed."""
    out = measurements(docs.drop("fail_bits"), text)
    bits = None
    for name, bad in _failed().items():
        bit = F.when(bad, F.lit(1 << RULES[name])).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    # Out of a generator, so that a filter on the bits stays above what they are made of: pushed down, it would take
    # every measurement again for each element of each array.
    return out.select("*", F.explode(F.array(bits)).alias("fail_bits"))


def apply_policy(entries: DataFrame, policy: Policy = V1, column: str = "kept") -> DataFrame:
    """The ledger with a verdict by `policy`; no text is read."""
    return entries.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def keep(docs: DataFrame, policy: Policy = V1, text: str = "text") -> DataFrame:
    """The rows of `docs` that `policy` keeps, with their own columns, also those that the ledger has too."""
    plain, kept = unused([*docs.columns, *MEASURED, "fail_bits"], "plain", "kept")
    whole = F.struct(*quoted(docs.columns))
    entries = ledger(docs.select(whole.alias(plain), *quoted([text])), text)
    return apply_policy(entries, policy, kept).where(F.col(kept)).select(f"{plain}.*")


def ablation(entries: DataFrame, policy: Policy = V1) -> DataFrame:
    """For each rule of `policy`: failures, documents that only it rejects, and documents kept without it.

    One aggregation over the distinct masks (at most 2^rules groups), whatever the number of documents.
    """
    spark = entries.sparkSession
    by_mask = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = spark.createDataFrame([(r, 1 << RULES[r]) for r in policy.rules], "rule string, bit long")
    pairs = by_mask.select("bits", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in policy.rules])).alias("r"))
    b, bit, n = F.col("bits"), F.col("r.bit"), F.col("n")
    out = pairs.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(b.bitwiseAND(bit) != 0, n).otherwise(0)).alias("n_failed"),
        F.sum(F.when(b == bit, n).otherwise(0)).alias("n_only"),
        F.sum(F.when((b == 0) | (b == bit), n).otherwise(0)).alias("n_kept_without"),
    )
    return rules.select("rule").join(out, "rule", "left").na.fill(0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of `documents` under the base rules and policy v1."""
    led = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(BASE.mask)) != 0).alias("base_failed"),
        "kept", "fail_bits",
    )


#: DuckDB: the measured columns of all documents.
MEASURE_SQL = r"""
WITH w AS (
  SELECT *, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM {docs}
), win AS (
  SELECT *, len(words)::BIGINT AS n_words,
         list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2]) AS tri
  FROM w
), keyed AS (
  SELECT row_number() OVER () AS rid, * FROM win
), reps AS (
  SELECT rid, count(DISTINCT p) AS n FROM (
    SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c
      FROM (SELECT rid, unnest(tri) AS g, unnest(range(1, len(tri) + 1)) AS i FROM keyed))
    WHERE c > 1) GROUP BY rid
), m AS (
  SELECT keyed.*,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_bangs,
    len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(reps.n, 0)::BIGINT AS n_repeat_words
  FROM keyed LEFT JOIN reps USING (rid)
), led AS (
  SELECT *,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
     + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
     + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END
     + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
     + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
     + CASE WHEN 100 * n_bangs > 60 * n_words THEN 32 ELSE 0 END)::BIGINT AS fail_bits
  FROM m
)
"""

SQL = MEASURE_SQL.replace("{docs}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits & 63 = 0 AS kept, fail_bits
FROM led
"""
