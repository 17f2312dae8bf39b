"""Operators on planes as arrays or as one row a pixel; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.stats import mean, nearest_rank, robust_scale, upper_median


def log_plane(pixels: Column, epsilon: float = 1.0) -> Column:
    """log2(v + epsilon); null where that is not defined."""
    return F.transform(pixels, lambda v: F.when(v + epsilon > 0, F.log2(v.cast("double") + epsilon)))


def anscombe(pixels: Column) -> Column:
    return F.transform(pixels, lambda v: 2 * F.sqrt(F.greatest(F.lit(0.0), v.cast("double")) + 0.375))


def remove_offset(pixels: Column, q: float = 0.01) -> Column:
    low = nearest_rank(pixels, q)
    return F.transform(pixels, lambda v: v - F.greatest(low, F.lit(0.0)))


def band(pixels: Column, floor: float, ceiling: float) -> Column:
    """Whether each pixel is inside the frame's intensity band: floor <= v < ceiling."""
    lo, hi = nearest_rank(pixels, floor), nearest_rank(pixels, ceiling)
    return F.transform(pixels, lambda v: (v >= lo) & (v < hi))


def pair_residuals(pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """Log gain (the median of b - a) and mean absolute residual before and after it, of each pair at rest."""
    a = frames.select("recording_id", F.col("frame").alias("from_frame"), F.col("plane").alias("a"))
    b = frames.select("recording_id", F.col("frame").alias("to_frame"), F.col("plane").alias("b"))
    d = pairs.join(a, ["recording_id", "from_frame"]).join(b, ["recording_id", "to_frame"])
    d = d.withColumn("d", F.zip_with(log_plane(F.col("a")), log_plane(F.col("b")), lambda x, y: y - x)).withColumn("log_gain", upper_median(F.col("d")))
    d = d.withColumn("r", F.transform("d", lambda x: x - F.col("log_gain")))
    return d.withColumns({"residual_before": mean(F.transform("d", F.abs)), "residual_after": mean(F.transform("r", F.abs)), "scale": robust_scale(F.col("r"))})


def explode_pixels(frames: DataFrame, width: int) -> DataFrame:
    """One row a pixel: (recording_id, frame, y, x, v)."""
    p = frames.select("recording_id", "frame", F.posexplode("plane").alias("i", "v"))
    return p.select("recording_id", "frame", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), F.col("v").cast("double").alias("v"))


def gradients(pixels: DataFrame) -> DataFrame:
    """Central differences, one-sided at the borders."""
    def along(c: str, other: str) -> Column:
        w = Window.partitionBy("recording_id", "frame", other).orderBy(c)
        before, after = F.lag("v").over(w), F.lead("v").over(w)
        return F.when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / 2)

    return pixels.withColumn("gx", along("x", "y")).withColumn("gy", along("y", "x"))


def frame_correlation(pixels: DataFrame) -> DataFrame:
    """Mean Pearson correlation of consecutive frames of each recording."""
    b = pixels.select("recording_id", (F.col("frame") - 1).alias("frame"), "y", "x", F.col("v").alias("w"))
    per = pixels.join(b, ["recording_id", "frame", "y", "x"]).groupBy("recording_id", "frame").agg(F.corr("v", "w").alias("c"))
    return per.groupBy("recording_id").agg(F.avg("c").alias("frame_correlation"))


def lag_instability(pixels: DataFrame, lags: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """Mean |difference| over each lag, its mean over lags, and its growth with log2 of the lag, of each pixel."""
    a = pixels.withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("to", F.col("frame") + F.col("lag"))
    b = pixels.select("recording_id", F.col("frame").alias("to"), "y", "x", F.col("v").alias("w"))
    per = a.join(b, ["recording_id", "to", "y", "x"]).groupBy("recording_id", "y", "x", "lag").agg(F.avg(F.abs(F.col("w") - F.col("v"))).alias("m"))
    return per.groupBy("recording_id", "y", "x").agg(F.avg("m").alias("instability"), F.regr_slope("m", F.log2("lag")).alias("growth"))


def share_rank(col: str) -> Column:
    """Rank of a pixel within its recording, 0 to 1; ties by place."""
    w = Window.partitionBy("recording_id")
    return (F.row_number().over(w.orderBy(col, "y", "x")) - 1) / F.greatest(F.lit(1), F.count(F.lit(1)).over(w) - 1)


def remove_lowest(scores: DataFrame, col: str, percent: float, strata: tuple[str, ...] = ()) -> DataFrame:
    """Marks the lowest round(percent * n / 100) pixels of each recording, or of each stratum of it."""
    w = Window.partitionBy("recording_id", *strata)
    rank, n = F.row_number().over(w.orderBy(col, "y", "x")), F.count(F.lit(1)).over(w)
    return scores.withColumn("removed", rank <= F.floor(F.lit(percent) * n / 100 + 0.5))
