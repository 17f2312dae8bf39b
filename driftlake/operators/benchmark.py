"""Result tables of benchmarks: merging, errors, resampling, gates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def left_join_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join whose right side has each key once at most; it fails, as a job, where it has not."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    once = F.when(n > 1, F.raise_error(F.concat(F.lit("a key occurs more than once: "), F.to_json(F.struct(*keys))))).otherwise(F.lit(True))
    return left.join(right.withColumn("_once", once).where(F.col("_once")).drop("_once"), keys, "left")


def merge_shards(shards: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shards, status ok | missing | repeated | unexpected): coverage of expected rows by shards, each once."""
    n = shards.groupBy(*keys).agg(F.count(F.lit(1)).alias("shards"))
    j = expected.select(*keys).distinct().withColumn("_e", F.lit(True)).join(n, keys, "full_outer")
    status = F.when(F.col("_e").isNull(), "unexpected").when(F.col("shards").isNull(), "missing").when(F.col("shards") > 1, "repeated").otherwise("ok")
    return j.select(*keys, F.coalesce("shards", F.lit(0)).alias("shards"), status.alias("status"))


def trajectory_errors(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Error quantiles of each recording from its poses: the errors' median, 90th percentile (nearest rank), largest and last."""
    j = truth.select("recording_id", "frame", F.col("x").alias("tx"), F.col("y").alias("ty")).join(found.select("recording_id", "frame", "x", "y"), ["recording_id", "frame"])
    e = j.withColumn("e", F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))).groupBy("recording_id").agg(F.sort_array(F.collect_list("e")).alias("s"), F.max_by("e", "frame").alias("terminal_error"))
    at = lambda q: F.get("s", F.floor(F.lit(q) * (F.size("s") - 1) + 0.5).cast("int"))
    return e.select("recording_id", at(0.5).alias("median_error"), at(0.9).alias("p90_error"), F.get("s", F.size("s") - 1).alias("max_error"), "terminal_error")


def draw(seed: int, *parts: Column | str) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the seed and the parts alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def bootstrap(values: DataFrame, stratum: str, item: str, value: str, rounds: int, seed: int = 7) -> DataFrame:
    """(round, mean): means of `rounds` resamples, drawn with replacement within each stratum, strata weighted alike.

    values: a row for each stratum and item. The draws are hashes, so that every run and every engine makes the same ones;
    nothing is collected: a round's draw j of a stratum is joined to its j-th value.
    """
    w = Window.partitionBy(stratum)
    ranked = values.where(F.col(value).isNotNull() & ~F.isnan(value)).select(stratum, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(item)) - 1).alias("_j"), F.count(F.lit(1)).over(w).alias("_n"))
    drawn = ranked.select(stratum, "_j", "_n", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    drawn = drawn.withColumn("_pick", F.pmod(draw(seed, stratum, "round", "_j"), F.col("_n")))
    hit = drawn.join(ranked.select(stratum, F.col("_j").alias("_pick"), "_v"), [stratum, "_pick"])
    per = hit.groupBy("round", stratum).agg(F.avg("_v").alias("_m"))
    return per.groupBy("round").agg(F.avg("_m").alias("mean"))


def interval(draws: DataFrame, fraction: float = 0.95) -> DataFrame:
    """(low, high): the middle `fraction` of resampled means, by interpolated quantiles."""
    a = (1 - fraction) / 2
    return draws.agg(F.percentile("mean", F.lit(a)).alias("low"), F.percentile("mean", F.lit(1 - a)).alias("high"))


def paired_test(draws: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(low, high, p): p counts resampled means at the threshold or above, and one more, so that it is never zero."""
    p = (1 + F.count_if(F.col("mean") >= threshold)) / (F.count(F.lit(1)) + 1)
    return draws.agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"), p.alias("p"))


def power(effects: DataFrame, group: str, item: str, value: str, sizes: list[int], rounds: int, margin: float, seed: int = 11) -> DataFrame:
    """(size, power): share of simulated studies of a size, drawn from the effects of each group, whose mean stays below the margin."""
    w = Window.partitionBy(group)
    ranked = effects.select(group, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(item)) - 1).alias("_j"), F.count(F.lit(1)).over(w).alias("_n"))
    totals = ranked.select(group, "_n").distinct()
    plan = totals.select(group, "_n", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    plan = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).select("*", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
    plan = plan.withColumn("_j", F.pmod(draw(seed, group, "size", "round", "i"), F.col("_n")))
    studies = plan.join(ranked.select(group, "_j", "_v"), [group, "_j"]).groupBy("size", "round").agg(F.avg("_v").alias("m"))
    return studies.groupBy("size").agg(F.avg((F.col("m") < margin).cast("double")).alias("power"))


def fairness(results: DataFrame, method: str, ok: Column) -> DataFrame:
    """Rows of each method: attempted, completed and failed, and whether it attempted as many as the others."""
    n = results.groupBy(method).agg(F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("completed"))
    n = n.withColumn("failed", F.col("attempted") - F.col("completed"))
    most = n.agg(F.max("attempted").alias("_most"))
    return n.crossJoin(F.broadcast(most)).withColumn("fair", F.col("attempted") == F.col("_most")).drop("_most")


def rigid_gate(results: DataFrame, by: str, error: str, turn: str, least_share: float, most_error: float, most_turn: float) -> DataFrame:
    """(group, n, share, passed): share of recordings within both bounds, held against the least one."""
    fine = (F.col(error) <= most_error) & (F.abs(turn) <= most_turn)
    g = results.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(fine.cast("double")).alias("share"))
    return g.withColumn("passed", F.col("share") >= least_share)


def guide_score(residuals: DataFrame, by: list[str], before: str, after: str) -> DataFrame:
    """Share of a guide's residual that a run takes away: its median over pairs, and how many pairs it makes worse."""
    gain = (F.col(before) - F.col(after)) / F.greatest(F.col(before), F.lit(1e-12))
    return residuals.withColumn("_g", gain).groupBy(*by).agg(F.median("_g").alias("median_gain"), F.avg((F.col("_g") < 0).cast("double")).alias("worse"))


def standardised(results: DataFrame, aliases: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """Result rows under canonical column and method names; a name without an alias stays."""
    out = results.select(*[F.col(old).alias(new) for new, old in columns.items()])
    if not aliases:
        return out
    names = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return out.withColumn("method", F.coalesce(names[F.col("method")], F.col("method")))


def envelope(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, json): an action's result as one JSON object; numbers that are not finite are null."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)).alias(c)
    return df.select(*keys, F.to_json(F.struct(*[finite(c) for c in values]), {"ignoreNullFields": "false"}).alias("json"))


def markdown(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(line_no, line): a report table in Markdown; `df` is a report of bounded size."""
    cells = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    body = df.select((F.row_number().over(Window.orderBy(*order)) + 2).alias("line_no"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    spark = df.sparkSession
    head = spark.createDataFrame([(1, "| " + " | ".join(columns) + " |"), (2, "|" + " --- |" * len(columns))], "line_no int, line string")
    return head.unionByName(body.withColumn("line_no", F.col("line_no").cast("int")))
