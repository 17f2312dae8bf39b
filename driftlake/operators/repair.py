"""Trajectories: chaining, steps, outliers, gap filling, gain, margins and motion features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.stats import upper_median


def by_frame():
    return Window.partitionBy("recording_id").orderBy("frame")


def so_far():
    return by_frame().rowsBetween(Window.unboundedPreceding, 0)


def ahead():
    return by_frame().rowsBetween(0, Window.unboundedFollowing)


def chain(steps: DataFrame) -> DataFrame:
    """Positions from steps (dx, dy) of each frame: translations add up. A missing step counts as zero with no support."""
    dx, dy = F.coalesce("dx", F.lit(0.0)), F.coalesce("dy", F.lit(0.0))
    return steps.select("recording_id", "frame", F.sum(dx).over(so_far()).alias("x"), F.sum(dy).over(so_far()).alias("y"), F.when(F.col("dx").isNull(), 0).otherwise(1).alias("support"))


def steps(poses: DataFrame, width: int = 1, height: int = 1) -> DataFrame:
    """Rigid-aware step magnitude of each frame from the one before; theta is zero where there is none."""
    r2 = (width**2 + height**2 - 2) / 12
    theta = F.col("theta") if "theta" in poses.columns else F.lit(0.0)
    d = lambda c: c - F.lag(c).over(by_frame())
    m = F.sqrt(d(F.col("x")) ** 2 + d(F.col("y")) ** 2 + 2 * r2 * (1 - F.cos(d(theta))))
    return poses.withColumn("step", m)


def outliers(poses: DataFrame, k: float = 6.0) -> DataFrame:
    """Marks steps beyond max(median + k * scale, 6 * median); recordings of fewer than 5 frames have none."""
    s = steps(poses)
    stats = s.where("step IS NOT NULL").groupBy("recording_id").agg(upper_median(F.collect_list("step")).alias("med"), F.count(F.lit(1)).alias("n"))
    dev = s.join(stats, "recording_id").where("step IS NOT NULL").groupBy("recording_id").agg(upper_median(F.collect_list(F.abs(F.col("step") - F.col("med")))).alias("mad"))
    both = s.join(stats, "recording_id", "left").join(dev, "recording_id", "left")
    far = F.greatest(F.col("med") + k * 1.4826 * F.col("mad"), 6 * F.col("med"))
    return both.withColumn("outlier", F.coalesce((F.col("n") >= 4) & (F.col("step") > far), F.lit(False))).drop("med", "mad", "n")


def fill(poses: DataFrame, trusted: str = "trusted") -> DataFrame:
    """Positions of untrusted frames between their nearest trusted ones; held at the ends."""
    seen = lambda c: F.when(F.col(trusted), F.col(c))
    out = poses
    for c in ("frame", "x", "y"):
        out = out.withColumn(f"_b{c}", F.last(seen(c), ignorenulls=True).over(so_far())).withColumn(f"_a{c}", F.first(seen(c), ignorenulls=True).over(ahead()))
    f = (F.col("frame") - F.col("_bframe")) / (F.col("_aframe") - F.col("_bframe"))
    for c in ("x", "y"):
        between = F.col(f"_b{c}") + (F.col(f"_a{c}") - F.col(f"_b{c}")) * f
        out = out.withColumn(f"{c}_filled", F.when(F.col(trusted), F.col(c)).when(F.col("_bframe").isNull(), F.col(f"_a{c}")).when(F.col("_aframe").isNull(), F.col(f"_b{c}")).otherwise(between))
    return out.withColumn("repair", F.when(F.col(trusted), F.lit(None)).otherwise(F.lit("UNSUPPORTED"))).drop("_bframe", "_aframe", "_bx", "_ax", "_by", "_ay")


def crop_margin(poses: DataFrame, reach: int = 0) -> DataFrame:
    """Whole pixels to cut on each side so that every frame covers the rest."""
    up = lambda c: F.ceil(F.max(F.greatest(c, F.lit(0.0)))) + reach
    return poses.groupBy("recording_id").agg(up(-F.col("x")).alias("left"), up(F.col("x")).alias("right"), up(-F.col("y")).alias("top"), up(F.col("y")).alias("bottom"))


def motion_features(poses: DataFrame) -> DataFrame:
    """Step quantiles, jump ratio, path efficiency, accelerations and reach of each recording."""
    s = steps(poses)
    s = s.withColumn("vx", F.col("x") - F.lag("x").over(by_frame())).withColumn("vy", F.col("y") - F.lag("y").over(by_frame()))
    s = s.withColumn("acc", F.hypot(F.col("vx") - F.lag("vx").over(by_frame()), F.col("vy") - F.lag("vy").over(by_frame())))
    s = s.withColumn("x0", F.first("x").over(by_frame())).withColumn("y0", F.first("y").over(by_frame())).withColumn("x1", F.last("x").over(ahead())).withColumn("y1", F.last("y").over(ahead()))
    s = s.withColumn("reach", F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0")))
    q = lambda c, p: F.percentile(c, F.lit(p))
    path = F.sum("step")
    return s.groupBy("recording_id").agg(
        q("step", 0.5).alias("median_step"), q("step", 0.9).alias("p90_step"), F.max("step").alias("max_step"),
        (F.max("step") / F.greatest(q("step", 0.5), F.lit(1e-9))).alias("jump_ratio"),
        (F.max(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))) / F.greatest(path, F.lit(1e-9))).alias("path_efficiency"),
        q("acc", 0.5).alias("median_acceleration"), q("acc", 0.9).alias("p90_acceleration"), F.max("acc").alias("max_acceleration"), q("reach", 0.9).alias("p90_reach"),
    )


def best_window(poses: DataFrame, k: int) -> DataFrame:
    """The k consecutive frames of each recording with the largest span of x; the earliest on ties."""
    w = by_frame().rowsBetween(0, k - 1)
    s = poses.select("recording_id", "frame", (F.max("x").over(w) - F.min("x").over(w)).alias("span"), F.count(F.lit(1)).over(w).alias("n")).where(F.col("n") == k)
    best = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("span"), "frame"))
    return s.withColumn("r", best).where("r = 1").select("recording_id", F.col("frame").alias("start"), "span")
