"""The analysis layer over result tables: scoring, clustered means, paired comparisons, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def balanced_mean(df: DataFrame, metric: str, item: list[str], cluster: str, kind: str, by: list[str]) -> DataFrame:
    """Mean over items, then over clusters, then the mean of the kinds' means."""
    m = df.groupBy(*by, kind, cluster, *item).agg(F.avg(metric).alias("m"))
    m = m.groupBy(*by, kind, cluster).agg(F.avg("m").alias("m"))
    m = m.groupBy(*by, kind).agg(F.avg("m").alias("m"), F.count(F.lit(1)).alias("clusters"))
    return m.groupBy(*by).agg(F.avg("m").alias("balanced_mean"), F.count(F.lit(1)).alias("kinds"), F.sum("clusters").alias("clusters"))


def penalised(metric: Column, ok: Column, penalty: Column) -> Column:
    return F.when(ok, metric).otherwise(penalty)


def holm(df: DataFrame, p: str, id_col: str, family: list[str]) -> DataFrame:
    """Holm's step-down adjustment of p-values within each family."""
    w = Window.partitionBy(*family).orderBy(p, id_col)
    m = F.count(F.lit(1)).over(Window.partitionBy(*family))
    raw = df.withColumn("_a", (m - F.row_number().over(w) + 1) * F.col(p))
    run = F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn("p_holm", F.least(F.lit(1.0), run)).drop("_a")


def completeness(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are missing from, or extra in, a table of results."""
    a, e = actual.select(*keys).distinct(), expected.select(*keys).distinct()
    missing = e.join(a, keys, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(a.join(e, keys, "left_anti").withColumn("problem", F.lit("extra")))


def first_per_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_r = 1").drop("_r")


def conflicts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys that occur with different values."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(*values).alias("variants")).where("variants > 1")


def compare(a: DataFrame, b: DataFrame, keys: list[str], field: str) -> DataFrame:
    """Full-outer comparison of a field: only in one table, equal, or different."""
    j = a.select(*keys, F.col(field).alias("_a"), F.lit(True).alias("_ia")).join(b.select(*keys, F.col(field).alias("_b"), F.lit(True).alias("_ib")), keys, "full_outer")
    kind = F.when(F.col("_ib").isNull(), "only_first").when(F.col("_ia").isNull(), "only_second").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("different")
    return j.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("largest"))
