"""Evidence, confidence, warnings and choices of recordings; all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions.stats import nearest_rank, upper_median
from driftlake.operators.repair import by_frame

#: Bounds of the information rule.
SPARSE_BELOW, MOVING_ABOVE = 0.50, 1.55
#: Largest distance of one feature, and of all together, from what a selector was trained on.
MOST_Z, MOST_RMS_Z = 8.0, 3.0
#: Supports, bands (floor, ceiling), filters and masks of the recipe grid.
GRID_SUPPORTS = ("ALL", "GRADIENT", "MUTUAL_NOISE_GRADIENT")
GRID_BANDS = (("full", None, None), ("no_top_10", None, 90.0), ("no_top_25", None, 75.0), ("no_bottom_25", 25.0, None))
GRID_FILTERS = ("NONE", "GAUSSIAN_0_7", "GAUSSIAN_1_0", "MEDIAN_3X3")
GRID_MASKS = ("NONE", "LEAST_INFORMATIVE_25")


def recipe_grid(spark) -> DataFrame:
    """(estimator, support, band, floor, ceiling, filter, mask): 96 log-ratio recipes, 16 of area correlation, 16 of its Newton form."""
    each = lambda df, name, values: df.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    nothing = F.lit(None).cast("double")
    bands = F.array(*[F.struct(F.lit(n).alias("band"), (nothing if lo is None else F.lit(lo)).alias("floor"), (nothing if hi is None else F.lit(hi)).alias("ceiling")) for n, lo, hi in GRID_BANDS])
    base = each(spark.range(0, 1, 1, 1).select(F.explode(bands).alias("b")).select("b.*"), "filter", GRID_FILTERS)
    wide = each(each(base, "support", GRID_SUPPORTS), "mask", GRID_MASKS).withColumn("estimator", F.lit("LOG_RATIO_FIT"))
    plain = each(base, "estimator", ("AREA_CORRELATION", "AREA_CORRELATION_NEWTON")).withColumns({"support": F.lit("ALL"), "mask": F.lit("NONE")})
    return wide.unionByName(plain)


def in_distribution(df: DataFrame, features: list[str], model: DataFrame) -> DataFrame:
    """`df` with in_distribution and rms_z: each feature within MOST_Z spreads of the model (feature, mean, scale), all
    together within MOST_RMS_Z; a feature without spread has to be its mean."""
    long = df.select("*", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("_f"))
    z = long.select("recording_id", "_f.*").join(F.broadcast(model), "feature")  # one row a feature
    z = z.withColumn("z", F.when(F.col("scale") > 0, (F.col("value") - F.col("mean")) / F.col("scale"))).withColumn("same", F.col("value") == F.col("mean"))
    bad = F.bool_or(F.when(F.col("z").isNull(), ~F.coalesce("same", F.lit(False))).otherwise(F.abs("z") > MOST_Z))
    got = z.groupBy("recording_id").agg(bad.alias("bad"), F.coalesce(F.sqrt(F.avg(F.col("z") * F.col("z"))), F.lit(0.0)).alias("rms_z"))
    return df.join(got.select("recording_id", (~F.col("bad") & (F.col("rms_z") <= MOST_RMS_Z)).alias("in_distribution"), "rms_z"), "recording_id", "left")


def one_hot(df: DataFrame, col: str, values: tuple[str, ...]) -> DataFrame:
    return df.withColumns({f"{col}_is_{v}": (F.col(col) == v).cast("int") for v in values})


def evidence_reason(frames: Column, height: Column, width: Column, low: Column, high: Column) -> Column:
    """Why a recording gives no evidence; empty where it does."""
    return (
        F.when(frames < 2, "fewer than two guide frames")
        .when((height < 16) | (width < 16), "guide plane smaller than 16x16")
        .when(~F.coalesce(high > low, F.lit(False)), "no finite positive raw-image dynamic range")
        .otherwise("")
    )


def best_gain(scores: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Of each group the candidate with the largest predicted gain, the first by name on ties; a fallback below the threshold."""
    best = scores.groupBy(*group).agg(F.max(F.struct("gain", F.struct(F.col("place").alias("place"), F.col("candidate").alias("candidate")).alias("who"))).alias("b"))
    return best.select(*group, F.col("b.who.candidate").alias("candidate"), F.col("b.gain").alias("gain"), (F.col("b.gain") < threshold).alias("fallback"))


def linear_gains(evidence: DataFrame, features: list[str], model: DataFrame) -> DataFrame:
    """(recording_id, candidate, gain): intercept and weighted features; model: (candidate, feature, weight), the feature '' for the intercept."""
    long = evidence.select("recording_id", F.explode(F.array(F.struct(F.lit("").alias("feature"), F.lit(1.0).alias("value")), *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("f"))
    both = long.select("recording_id", "f.feature", "f.value").join(F.broadcast(model), "feature")  # a row a weight
    return both.groupBy("recording_id", "candidate").agg(F.sum(F.col("weight") * F.col("value")).alias("gain"))


def information_choice(sparse: Column, tail: Column, explicit: Column) -> Column:
    return (
        F.when(explicit, "EXPLICIT_INTENSITY_BAND")
        .when(sparse < SPARSE_BELOW, "SPARSE_MUTUAL_NOISE_EDGES")
        .when(tail > MOVING_ABOVE, "MOVING_STANDARD_GRADIENT")
        .otherwise("STABLE_EXCLUDE_BRIGHTEST_TEN_PERCENT")
    )


def rotation_gain(image: Column, p90_step: Column) -> Column:
    """The least gain that a rotation must bring: a fixed value for each type, for phase contrast less where it moves far."""
    return (
        F.when(image == "BRIGHTFIELD_DIC", 0.001).when(image == "DENSE_FLUORESCENCE", 0.002).when(image == "FIDUCIAL_STATIC", 0.005)
        .when(image == "SPARSE_LOW_LIGHT_FLUORESCENCE", 0.010).when((image == "PHASE_CONTRAST") & (p90_step > 2), 0.005).otherwise(0.010)
    )


def linearity(poses: DataFrame) -> DataFrame:
    """(recording_id, residual): how far, as a root mean square, the path is from the best line in time."""
    part = lambda c: F.regr_syy(c, "frame") - F.coalesce(F.regr_sxy(c, "frame") * F.regr_sxy(c, "frame") / F.nullif(F.regr_sxx(c, "frame"), F.lit(0.0)), F.lit(0.0))
    return poses.groupBy("recording_id").agg(F.sqrt(F.greatest(F.lit(0.0), (part("x") + part("y")) / F.count(F.lit(1)))).alias("residual"))


def filter_choice(scores: dict[str, Column], thresholds: dict[str, float]) -> Column:
    """The recipe of the filter rules: a mask first (with the median where that clears too), then the median, then the
    narrow and the wide Gaussian; scores and thresholds by "mask", "median_mask", "median", "gaussian_0_7", "gaussian_1_0"."""
    over = {k: F.coalesce(scores[k] > thresholds[k], F.lit(False)) for k in scores}
    return (
        F.when(over["mask"] & over["median_mask"], "MEDIAN_3X3_AND_SPATIAL_MASK_25").when(over["mask"], "SPATIAL_MASK_25").when(over["median"], "MEDIAN_3X3")
        .when(over["gaussian_0_7"], "GAUSSIAN_0_7").when(over["gaussian_1_0"], "GAUSSIAN_1_0").otherwise("NONE")
    )


def weighting_choice(gains: DataFrame, threshold: float, fixed_only: bool = True) -> DataFrame:
    """(recording_id, weighting, fallback): the weighting with the best predicted gain (columns uncertainty, robust, combined)
    if it clears the threshold; a model that is fixed_only always falls back to EQUAL."""
    names = ("UNCERTAINTY", "ROBUST", "COMBINED")
    long = gains.select("recording_id", F.explode(F.array(*[F.struct(F.col(n.lower()).alias("gain"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate(names)])).alias("g"))
    best = long.groupBy("recording_id").agg(F.max("g").alias("g"))
    ok = F.coalesce(F.col("g.gain") >= threshold, F.lit(False)) & F.lit(not fixed_only)
    return best.select("recording_id", F.when(ok, F.col("g.name")).otherwise("EQUAL").alias("weighting"), (~ok).alias("fallback"))


def sparse_score(pixels: Column) -> Column:
    """Where the median lies between the first and the last percentile."""
    low, high = nearest_rank(pixels, 0.01), nearest_rank(pixels, 0.99)
    return (upper_median(pixels) - low) / F.greatest(F.lit(1e-9), high - low)


def confidence(scores: DataFrame, by: str = "recording_id", score: str = "score", spreads: float = 2.5, least: float = 0.18, most: float = 0.50) -> DataFrame:
    """`scores` with a confidence from 0 to 1: the place of a score between a floor and the median."""
    w = Window.partitionBy(by)
    s = scores.withColumn("_med", F.median(score).over(w)).withColumn("_dev", F.abs(F.col(score) - F.col("_med")))
    s = s.withColumn("_floor", F.greatest(F.lit(least), F.least(F.lit(most), F.col("_med") - spreads * 1.4826 * F.median("_dev").over(w))))
    c = (F.col(score) - F.col("_floor")) / F.greatest(F.col("_med") - F.col("_floor"), F.lit(0.05))
    return s.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).drop("_med", "_dev", "_floor")


def weak_boundaries(responses: DataFrame, response: str = "response") -> DataFrame:
    """Frames whose response to the one before is below min(0.20, 0.35 * median) of the recording."""
    cut = F.least(F.lit(0.20), F.lit(0.35) * F.median(response).over(Window.partitionBy("recording_id")))
    return responses.withColumn("_cut", cut).where(F.col(response) < F.col("_cut")).drop("_cut")


def reference_frames(light: DataFrame) -> DataFrame:
    """(recording_id, bright, dim): of the frames with structure the lightest and the darkest, the earlier one on ties;
    all frames where fewer than four have structure. light: (recording_id, frame, light, structure)."""
    w = Window.partitionBy("recording_id")
    s = light.withColumn("_ok", F.col("structure") >= F.greatest(F.lit(1e-6), F.lit(0.35) * F.median("structure").over(w)))
    s = s.withColumn("_n", F.sum(F.col("_ok").cast("int")).over(w)).where("_ok OR _n < 4")
    return s.groupBy("recording_id").agg(F.max_by("frame", F.struct("light", -F.col("frame"))).alias("bright"), F.min_by("frame", F.struct("light", "frame")).alias("dim"))


def protected(owners: DataFrame, least_gain: float) -> DataFrame:
    """Frames that outlier repair leaves alone: the pair that owns them is OK or took away `least_gain` of residual."""
    usable = F.col("status") != "REFUSED_LOW_OVERLAP"
    return owners.withColumn("protected", usable & ((F.col("status") == "OK") | (F.col("residual_before") - F.col("residual_after") >= least_gain)))


def warnings(owned: DataFrame, pairs: DataFrame, max_shift: float, max_rotation_degrees: float) -> DataFrame:
    """(recording_id, kind, n, message): bounds that frames ended on (by the pair that owns them) and refused pairs."""
    shift = F.count_if(F.col("status").isin("AT_SHIFT_BOUND", "AT_SHIFT_AND_ROTATION_BOUND"))
    turn = F.count_if(F.col("status").isin("AT_ROTATION_BOUND", "AT_SHIFT_AND_ROTATION_BOUND"))
    a = owned.groupBy("recording_id").agg(shift.alias("shift"), turn.alias("turn"))
    b = pairs.groupBy("recording_id").agg(F.count_if(F.col("status") == "REFUSED_LOW_OVERLAP").alias("refused"), F.count(F.lit(1)).alias("pairs"))
    j = a.join(b, "recording_id")
    rows = F.array(
        F.struct(F.lit("AT_SHIFT_BOUND").alias("kind"), F.col("shift").alias("n"), F.format_string(f"%d frame(s) ended on the {max_shift:.1f} px maximum-shift bound", "shift").alias("message")),
        F.struct(F.lit("AT_ROTATION_BOUND").alias("kind"), F.col("turn").alias("n"), F.format_string(f"%d frame(s) ended on the {max_rotation_degrees:.2f} degree maximum-rotation bound", "turn").alias("message")),
        F.struct(F.lit("REFUSED_PAIRS").alias("kind"), F.col("refused").alias("n"), F.format_string("%d of %d pairs had too few usable pixels and were refused", "refused", "pairs").alias("message")),
    )
    return j.select("recording_id", F.explode(rows).alias("w")).select("recording_id", "w.*").where("n > 0")


def counters(influences: DataFrame) -> DataFrame:
    """Edges of each recording that were used, weighted down, without a covariance, or at the least weight."""
    return influences.groupBy("recording_id").agg(
        F.count_if("used").alias("used"), F.count_if(F.col("used") & (F.col("factor") < 1)).alias("down_weighted"),
        F.count_if(F.col("used") & (F.col("factor") <= 0.05 + 1e-15)).alias("at_least_weight"), F.count_if(F.col("used") & F.col("fallback")).alias("unavailable"),
    )


def with_influences(pairs: DataFrame, influences: DataFrame) -> DataFrame:
    """Pairs with what the solution made of them; those that it did not use are marked so."""
    j = pairs.join(influences.select("recording_id", "plan_index", "factor", F.lit(True).alias("used")), ["recording_id", "plan_index"], "left")
    return j.withColumns({"used": F.coalesce("used", F.lit(False)), "influence": F.when(F.col("used"), "used").otherwise("not_used")})


def rebase(poses: DataFrame, anchor: DataFrame) -> DataFrame:
    """Poses (x, y, theta) relative to the frame that `anchor` (recording_id, frame) names."""
    a = poses.join(anchor, ["recording_id", "frame"]).select("recording_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("theta").alias("_t"))
    j = poses.join(a, "recording_id")
    turn = F.col("theta") - F.col("_t")
    c, s = F.cos(turn), F.sin(turn)
    # the inverse of the anchor's pose first, then the pose
    return j.withColumns({"x": F.col("x") - (c * F.col("_x") - s * F.col("_y")), "y": F.col("y") - (s * F.col("_x") + c * F.col("_y")), "theta": turn}).drop("_x", "_y", "_t")


def jump_cuts(poses: DataFrame, least: float = 2.0) -> DataFrame:
    """Frames where a step and the move between the medians of three frames on each side are `least` pixels or more."""
    left, right = by_frame().rowsBetween(-3, -1), by_frame().rowsBetween(0, 2)
    def med(c: str, w) -> Column:
        v = F.sort_array(F.collect_list(c).over(w))  # three values at most
        return (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2

    step = F.hypot(F.col("x") - F.lag("x").over(by_frame()), F.col("y") - F.lag("y").over(by_frame()))
    s = poses.withColumn("step", step).withColumn("move", F.hypot(med("x", right) - med("x", left), med("y", right) - med("y", left)))
    return s.where((F.col("step") >= least) & (F.col("move") >= least)).select("recording_id", "frame", "step", "move")


def local_peaks(pixels: DataFrame, k: int) -> DataFrame:
    """The k highest pixels of each frame that none of their eight neighbours exceeds; ties by place.

    pixels: (recording_id, frame, y, x, v). Neighbours are looked up by windows along rows, then along columns.
    """
    def widest(col: str, part: str, order: str) -> Column:
        w = Window.partitionBy("recording_id", "frame", part).orderBy(order)
        return F.greatest(F.col(col), F.lag(col).over(w), F.lead(col).over(w))

    p = pixels.withColumn("_row", widest("v", "y", "x")).withColumn("_all", widest("_row", "x", "y")).where(F.col("v") >= F.col("_all"))
    rank = F.row_number().over(Window.partitionBy("recording_id", "frame").orderBy(F.desc("v"), "y", "x"))
    return p.withColumn("peak", rank).where(F.col("peak") <= k).select("recording_id", "frame", "peak", "y", "x", "v")
