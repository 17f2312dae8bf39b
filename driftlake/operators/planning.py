"""Frame numbering and pair plans. Pairs are planned on ids by equi-joins; pixels join late."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAGS = (1, 2, 4, 8, 16)


def number_frames(df: DataFrame, recording: str, order: list[str], frame: str = "frame") -> DataFrame:
    """0-based frame numbers of each recording."""
    return df.withColumn(frame, F.row_number().over(Window.partitionBy(recording).orderBy(*order)) - 1)


def consecutive(frames: DataFrame) -> DataFrame:
    w = Window.partitionBy("recording_id").orderBy("frame")
    return frames.select("recording_id", F.col("frame").alias("from_frame"), F.lead("frame").over(w).alias("to_frame")).where("to_frame IS NOT NULL")


def multilag(frames: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """All pairs (t, t + lag) of a recording, in the order of t and then of the lags; an equi-join, never a range join."""
    if 1 not in lags:
        raise ValueError("a multi-lag plan needs lag 1")
    left = frames.select("recording_id", F.col("frame").alias("from_frame"), F.posexplode(F.array(*map(F.lit, lags))).alias("lag_index", "lag"))
    left = left.withColumn("to_frame", F.col("from_frame") + F.col("lag"))
    pairs = left.join(frames.select("recording_id", F.col("frame").alias("to_frame")), ["recording_id", "to_frame"])
    w = Window.partitionBy("recording_id").orderBy("from_frame", "lag_index")
    return pairs.select("recording_id", "from_frame", "to_frame", "lag", (F.row_number().over(w) - 1).alias("plan_index"))


def multi_scale(frames: DataFrame) -> DataFrame:
    """Pairs at gaps of 1, 3, 9, 27 and so on, and over the whole recording: ends at multiples of the gap and the last frame."""
    n = frames.groupBy("recording_id").agg(F.max("frame").cast("int").alias("last"))
    powers = F.filter(F.transform(F.sequence(F.lit(0), F.lit(18)), lambda k: F.pow(F.lit(3.0), k).cast("int")), lambda g: g <= F.col("last"))
    gaps = n.where("last > 0").select("recording_id", "last", F.explode(F.array_distinct(F.concat(powers, F.array("last")))).alias("gap"))
    ends = F.array_distinct(F.concat(F.sequence(F.col("gap"), F.col("last"), F.col("gap")), F.array("last")))
    return gaps.select("recording_id", "gap", F.explode(ends).alias("to_frame")).select("recording_id", "gap", (F.col("to_frame") - F.col("gap")).alias("from_frame"), "to_frame")


def fixed(frames: DataFrame, reference: int = 0) -> DataFrame:
    return frames.where(F.col("frame") != reference).select("recording_id", F.lit(reference).alias("from_frame"), F.col("frame").alias("to_frame"))


def owners(pairs: DataFrame) -> DataFrame:
    """The pair that owns each frame: the shortest lag that ends there, the first in the plan on ties."""
    w = Window.partitionBy("recording_id", "to_frame").orderBy("lag", "plan_index")
    return pairs.withColumn("r", F.row_number().over(w)).where("r = 1").select("recording_id", F.col("to_frame").alias("frame"), "from_frame", "lag", "plan_index")


def event_cross(frames: DataFrame, events: DataFrame, window: int = 3) -> DataFrame:
    """Pre x post frames within `window` of each event (recording_id, event_frame): a range join by exploded frames."""
    e = events.select("recording_id", "event_frame", F.explode(F.sequence(F.col("event_frame") - window, F.col("event_frame") - 1)).alias("from_frame"))
    e = e.select("*", F.explode(F.sequence(F.col("event_frame"), F.col("event_frame") + (window - 1))).alias("to_frame"))
    ids = frames.select("recording_id", "frame")
    e = e.join(ids.withColumnRenamed("frame", "from_frame"), ["recording_id", "from_frame"])
    return e.join(ids.withColumnRenamed("frame", "to_frame"), ["recording_id", "to_frame"]).select("recording_id", "event_frame", "from_frame", "to_frame")


def sweep_grid(spark, axes: dict[str, list], most: int = 24) -> DataFrame:
    """Cartesian grid of up to three parameter axes; a grid of more than `most` runs is refused."""
    if not 1 <= len(axes) <= 3:
        raise ValueError("a sweep has one to three axes")
    n = 1
    for name, values in axes.items():
        if len(set(values)) != len(values) or not values:
            raise ValueError(f"axis {name} repeats a value or has none")
        n *= len(values)
    if n > most:
        raise ValueError(f"{n} runs are more than {most}")
    from itertools import product

    return spark.createDataFrame(list(product(*axes.values())), list(axes))
