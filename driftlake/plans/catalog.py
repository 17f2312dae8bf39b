"""Registered queries of the engine and the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlake.functions import stats
from driftlake.operators import analysis, pixels, planning, repair
from driftlake.plans.tables import PLANES_SQL, POSES_SQL, RESULTS_SQL, frames, planes, poses, read, results

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("@planes", f"({PLANES_SQL})").replace("@poses", f"({POSES_SQL})").replace("@results", f"({RESULTS_SQL})")
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- pair plans ---------------------------------------------------------------------------------------------------

MULTILAG = """SELECT a.recording_id, a.frame AS from_frame, b.frame AS to_frame, l.lag,
  row_number() OVER (PARTITION BY a.recording_id ORDER BY a.frame, l.lag) - 1 AS plan_index
  FROM @planes a JOIN (SELECT unnest([1, 2, 4, 8, 16]) AS lag) l ON true JOIN @planes b ON a.recording_id = b.recording_id AND b.frame = a.frame + l.lag"""


@query("SELECT a.recording_id, a.frame AS from_frame, a.frame + 1 AS to_frame FROM @planes a JOIN @planes b ON a.recording_id = b.recording_id AND b.frame = a.frame + 1")
def pair_plan_consecutive(spark, sf):
    return planning.consecutive(frames(spark, sf))


@query(MULTILAG)
def pair_plan_multilag(spark, sf):
    return planning.multilag(frames(spark, sf))


@query("SELECT recording_id, 0 AS from_frame, frame AS to_frame FROM @planes WHERE frame <> 0")
def pair_plan_fixed(spark, sf):
    return planning.fixed(frames(spark, sf))


@query(f"SELECT recording_id, to_frame AS frame, arg_min(from_frame, lag * 1000000 + plan_index) AS from_frame, min(lag) AS lag, arg_min(plan_index, lag * 1000000 + plan_index) AS plan_index FROM ({MULTILAG}) GROUP BY 1, 2")
def pair_owner(spark, sf):
    return planning.owners(planning.multilag(frames(spark, sf)))


@query("""WITH e AS (SELECT recording_id, frame AS event_frame FROM @poses WHERE event_type = 'error')
SELECT e.recording_id, event_frame, a.frame AS from_frame, b.frame AS to_frame FROM e
JOIN @poses a ON a.recording_id = e.recording_id AND a.frame BETWEEN event_frame - 3 AND event_frame - 1
JOIN @poses b ON b.recording_id = e.recording_id AND b.frame BETWEEN event_frame AND event_frame + 2""")
def event_cross_pairs(spark, sf):
    p = poses(spark, sf)
    return planning.event_cross(p, p.where("event_type = 'error'").select("recording_id", F.col("frame").alias("event_frame")))


@query("SELECT s, b, m FROM (SELECT unnest(['ALL', 'GRADIENT', 'MUTUAL_NOISE_GRADIENT']) AS s), (SELECT unnest(['FULL', 'NO_TOP_10', 'NO_TOP_25', 'NO_BOTTOM_25']) AS b), (SELECT unnest(['NONE', 'LEAST_INFORMATIVE_25']) AS m)")
def sweep_grid_cartesian(spark, sf):
    return planning.sweep_grid(spark, {"s": ["ALL", "GRADIENT", "MUTUAL_NOISE_GRADIENT"], "b": ["FULL", "NO_TOP_10", "NO_TOP_25", "NO_BOTTOM_25"], "m": ["NONE", "LEAST_INFORMATIVE_25"]})


# --- pairs at rest ------------------------------------------------------------------------------------------------

PAIRS = f"""SELECT p.*, list_transform(list_zip(a.plane, b.plane), lambda z: log2(z[2]::DOUBLE + 1) - log2(z[1]::DOUBLE + 1)) AS d
  FROM ({MULTILAG}) p JOIN @planes a ON a.recording_id = p.recording_id AND a.frame = from_frame JOIN @planes b ON b.recording_id = p.recording_id AND b.frame = to_frame"""
GAINED = f"SELECT *, list_sort(d)[len(d) // 2 + 1] AS log_gain FROM ({PAIRS})"
RESID = f"SELECT *, list_transform(d, lambda x: x - log_gain) AS r FROM ({GAINED})"


def _pairs(spark, sf):
    p = planes(spark, sf)
    return pixels.pair_residuals(planning.multilag(p), p)


@query(f"SELECT recording_id, from_frame, to_frame, round(log_gain, 6) AS log_gain, round(list_avg(list_transform(d, lambda x: abs(x))), 6) AS residual_before, round(list_avg(list_transform(r, lambda x: abs(x))), 6) AS residual_after FROM ({RESID})")
def pair_residual_before_after_gain(spark, sf):
    return _pairs(spark, sf).select("recording_id", "from_frame", "to_frame", *r6("log_gain", "residual_before", "residual_after"))


SCALE = f"SELECT *, list_sort(list_transform(r, lambda x: abs(x))) AS a FROM ({RESID})"
SCALED = f"SELECT *, greatest(1e-4, CASE WHEN a[len(a) // 2 + 1] > 0 THEN 1.4826 * a[len(a) // 2 + 1] ELSE a[floor(0.9 * (len(a) - 1) + 0.5)::INT + 1] END) AS scale FROM ({SCALE})"


@query(f"SELECT recording_id, from_frame, to_frame, round(scale, 6) AS scale FROM ({SCALED})")
def robust_scale_mad(spark, sf):
    return _pairs(spark, sf).select("recording_id", "from_frame", "to_frame", *r6("scale"))


@query(f"SELECT recording_id, from_frame, to_frame, round(list_sum(list_transform(r, lambda x: CASE WHEN abs(x / scale) <= 1.345 THEN 1.0 ELSE 1.345 / abs(x / scale) END)), 5) AS weight FROM ({SCALED})")
def robust_weights_huber(spark, sf):
    w = F.aggregate("r", F.lit(0.0), lambda a, x: a + stats.huber_weight(x / F.col("scale")))
    return _pairs(spark, sf).select("recording_id", "from_frame", "to_frame", F.round(w, 5).alias("weight"))


@query(f"SELECT recording_id, from_frame, to_frame, round(list_sum(list_transform(r, lambda x: CASE WHEN abs(x / scale) < 4.685 THEN (1 - (x / scale / 4.685) * (x / scale / 4.685)) * (1 - (x / scale / 4.685) * (x / scale / 4.685)) ELSE 0.0 END)), 5) AS weight FROM ({SCALED})")
def robust_weights_tukey(spark, sf):
    w = F.aggregate("r", F.lit(0.0), lambda a, x: a + stats.tukey_weight(x / F.col("scale")))
    return _pairs(spark, sf).select("recording_id", "from_frame", "to_frame", F.round(w, 5).alias("weight"))


# --- planes -------------------------------------------------------------------------------------------------------


@query("SELECT recording_id, frame, round(list_avg(list_transform(plane, lambda v: log2(v::DOUBLE + 1))), 6) AS mean_log, round(list_max(list_transform(plane, lambda v: log2(v::DOUBLE + 1))), 6) AS max_log FROM @planes")
def log_plane_stats(spark, sf):
    log = pixels.log_plane(F.col("plane"))
    return planes(spark, sf).select("recording_id", "frame", F.round(stats.mean(log), 6).alias("mean_log"), F.round(F.array_max(log), 6).alias("max_log"))


@query("SELECT recording_id, frame, round(list_sum(list_transform(plane, lambda v: 2 * sqrt(greatest(0.0, v::DOUBLE) + 0.375))), 5) AS total FROM @planes")
def anscombe(spark, sf):
    return planes(spark, sf).select("recording_id", "frame", F.round(F.aggregate(pixels.anscombe(F.col("plane")), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT recording_id, frame, len(list_filter(plane, lambda v: v >= list_sort(plane)[17] AND v < list_sort(plane)[58]))::BIGINT AS n_valid FROM @planes")
def intensity_band_valid(spark, sf):
    inside = pixels.band(F.col("plane"), 0.25, 0.90)
    return planes(spark, sf).select("recording_id", "frame", F.size(F.filter(inside, lambda x: x)).cast("long").alias("n_valid"))


@query("SELECT recording_id, frame, round(list_sort(plane)[floor(0.25 * 63 + 0.5)::INT + 1]::DOUBLE, 6) AS p25, round(list_sort(plane)[33]::DOUBLE, 6) AS upper_median, round(list_sort(plane)[ceil(0.9 * 64)::INT]::DOUBLE, 6) AS ceil90 FROM @planes")
def percentile_nearest(spark, sf):
    p = F.col("plane")
    cols = {"p25": stats.nearest_rank(p, 0.25), "upper_median": stats.upper_median(p), "ceil90": stats.ceil_rank(p, 0.9)}
    return planes(spark, sf).select("recording_id", "frame", *[F.round(c.cast("double"), 6).alias(n) for n, c in cols.items()])


PIXELS = "SELECT recording_id, frame, i // 8 AS y, i % 8 AS x, plane[i + 1]::DOUBLE AS v FROM (SELECT *, unnest(range(64))::INT AS i FROM @planes)"
GRAD = f"""SELECT *, CASE WHEN lag(v) OVER wx IS NULL THEN lead(v) OVER wx - v WHEN lead(v) OVER wx IS NULL THEN v - lag(v) OVER wx ELSE (lead(v) OVER wx - lag(v) OVER wx) / 2 END AS gx,
  CASE WHEN lag(v) OVER wy IS NULL THEN lead(v) OVER wy - v WHEN lead(v) OVER wy IS NULL THEN v - lag(v) OVER wy ELSE (lead(v) OVER wy - lag(v) OVER wy) / 2 END AS gy
  FROM ({PIXELS}) WINDOW wx AS (PARTITION BY recording_id, frame, y ORDER BY x), wy AS (PARTITION BY recording_id, frame, x ORDER BY y)"""


def _pix(spark, sf):
    return pixels.explode_pixels(planes(spark, sf), 8)


@query(f"SELECT recording_id, frame, round(avg(gx), 6) AS gx, round(avg(gy), 6) AS gy, round(max(sqrt(gx * gx + gy * gy)), 6) AS strongest FROM ({GRAD}) GROUP BY 1, 2")
def frame_gradient(spark, sf):
    g = pixels.gradients(_pix(spark, sf))
    return g.groupBy("recording_id", "frame").agg(F.round(F.avg("gx"), 6).alias("gx"), F.round(F.avg("gy"), 6).alias("gy"), F.round(F.max(F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2)), 6).alias("strongest"))


@query(f"SELECT recording_id, frame, round(skewness_pop(v), 5) AS skewness, round(kurtosis_pop(v), 5) AS kurtosis, round(quantile_cont(v, 0.95), 6) AS p95, round(stddev_pop(v), 6) AS sd FROM (SELECT *, v FROM ({PIXELS})) GROUP BY 1, 2".replace("skewness_pop(v)", "(avg(v*v*v) - 3*avg(v)*avg(v*v) + 2*avg(v)*avg(v)*avg(v)) / (var_pop(v) * sqrt(var_pop(v)))").replace("SELECT *, v FROM", "SELECT * FROM"))
def image_moments(spark, sf):
    p = _pix(spark, sf).groupBy("recording_id", "frame")
    return p.agg(F.round(F.skewness("v"), 5).alias("skewness"), F.round(F.kurtosis("v"), 5).alias("kurtosis"), F.round(F.percentile("v", F.lit(0.95)), 6).alias("p95"), F.round(F.stddev_pop("v"), 6).alias("sd"))


@query(f"SELECT recording_id, frame, round(-sum(n / 64.0 * log2(n / 64.0)) / 5, 6) AS entropy FROM (SELECT recording_id, frame, least(31, floor((v - lo) / (hi - lo) * 32)) AS b, count(*) AS n FROM (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM ({PIXELS}) WINDOW w AS (PARTITION BY recording_id, frame)) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def frame_histogram_entropy(spark, sf):
    w = Window.partitionBy("recording_id", "frame")
    p = _pix(spark, sf).withColumns({"lo": F.min("v").over(w), "hi": F.max("v").over(w)})
    n = p.groupBy("recording_id", "frame", F.least(F.lit(31), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 32)).alias("b")).count()
    share = F.col("count") / 64
    return n.groupBy("recording_id", "frame").agg(F.round(-F.sum(share * F.log2(share)) / 5, 6).alias("entropy"))


@query(f"SELECT recording_id, round(avg(c), 6) AS frame_correlation FROM (SELECT a.recording_id, a.frame, corr(a.v, b.v) AS c FROM ({PIXELS}) a JOIN ({PIXELS}) b ON a.recording_id = b.recording_id AND a.x = b.x AND a.y = b.y AND b.frame = a.frame + 1 GROUP BY 1, 2) GROUP BY 1")
def frame_correlation(spark, sf):
    return pixels.frame_correlation(_pix(spark, sf)).select("recording_id", *r6("frame_correlation"))


INSTAB = f"""SELECT recording_id, y, x, avg(m) AS instability, regr_slope(m, log2(lag)) AS growth FROM (SELECT a.recording_id, a.y, a.x, lag, avg(abs(b.v - a.v)) AS m
  FROM ({PIXELS}) a JOIN (SELECT unnest([1, 2, 4]) AS lag) l ON true JOIN ({PIXELS}) b ON a.recording_id = b.recording_id AND a.x = b.x AND a.y = b.y AND b.frame = a.frame + lag GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""


@query(f"SELECT recording_id, y, x, round(instability, 6) AS instability, round(growth, 6) AS growth FROM ({INSTAB})")
def pixel_lag_instability(spark, sf):
    return pixels.lag_instability(_pix(spark, sf)).select("recording_id", F.col("y").cast("long"), F.col("x").cast("long"), *r6("instability", "growth"))


@query(f"SELECT recording_id, y, x, round((row_number() OVER (PARTITION BY recording_id ORDER BY round(instability, 9), y, x) - 1) / 63.0, 6) AS trust_rank, row_number() OVER (PARTITION BY recording_id ORDER BY round(instability, 9), y, x) <= 16 AS removed FROM ({INSTAB})")
def mask_bottom_quartile(spark, sf):
    s = pixels.lag_instability(_pix(spark, sf)).withColumn("instability", F.round("instability", 9))
    s = s.withColumn("trust_rank", F.round(pixels.share_rank("instability"), 6))
    return pixels.remove_lowest(s, "instability", 25).select("recording_id", F.col("y").cast("long"), F.col("x").cast("long"), "trust_rank", "removed")


@query(f"SELECT recording_id, y, x, row_number() OVER (PARTITION BY recording_id, y // 4, x // 4 ORDER BY round(instability, 9), y, x) <= 4 AS removed FROM ({INSTAB})")
def stratified_mask(spark, sf):
    s = pixels.lag_instability(_pix(spark, sf)).withColumns({"instability": F.round("instability", 9), "cy": F.floor(F.col("y") / 4), "cx": F.floor(F.col("x") / 4)})
    return pixels.remove_lowest(s, "instability", 25, ("cy", "cx")).select("recording_id", F.col("y").cast("long"), F.col("x").cast("long"), "removed")


@query(f"SELECT recording_id, y, x, round(max(v), 6) AS v FROM ({PIXELS}) GROUP BY 1, 2, 3")
def max_projection(spark, sf):
    return _pix(spark, sf).groupBy("recording_id", F.col("y").cast("long"), F.col("x").cast("long")).agg(F.round(F.max("v"), 6).alias("v"))


# --- trajectories -------------------------------------------------------------------------------------------------


@query("SELECT recording_id, frame, round(sum(x) OVER w, 4) AS x, round(sum(y) OVER w, 4) AS y, 1 AS support FROM @poses WINDOW w AS (PARTITION BY recording_id ORDER BY frame)")
def trajectory_chain_cumsum(spark, sf):
    c = repair.chain(poses(spark, sf).select("recording_id", "frame", F.col("x").alias("dx"), F.col("y").alias("dy")))
    return c.select("recording_id", "frame", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "support")


STEPS = "SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step FROM @poses WINDOW w AS (PARTITION BY recording_id ORDER BY frame)"


@query(f"SELECT recording_id, frame, round(step, 6) AS step FROM ({STEPS})")
def step_magnitude(spark, sf):
    return repair.steps(poses(spark, sf)).select("recording_id", "frame", *r6("step"))


@query(f"""WITH s AS ({STEPS}), m AS (SELECT recording_id, list_sort(list(step) FILTER (step IS NOT NULL)) AS l FROM s GROUP BY 1),
d AS (SELECT s.recording_id, list_sort(list(abs(step - l[len(l) // 2 + 1])) FILTER (step IS NOT NULL)) AS a, any_value(l) AS l FROM s JOIN m USING (recording_id) GROUP BY 1)
SELECT s.recording_id, frame, coalesce(len(l) >= 4 AND step > greatest(l[len(l) // 2 + 1] + 1.2 * 1.4826 * a[len(a) // 2 + 1], 6 * l[len(l) // 2 + 1]), false) AS outlier FROM s JOIN d USING (recording_id)""")
def outlier_steps(spark, sf):
    return repair.outliers(poses(spark, sf), 1.2).select("recording_id", "frame", "outlier")


@query("""WITH p AS (SELECT *, event_type <> 'error' AS trusted FROM @poses), b AS (SELECT *,
 last_value(CASE WHEN trusted THEN frame END IGNORE NULLS) OVER w AS bf, last_value(CASE WHEN trusted THEN x END IGNORE NULLS) OVER w AS bx, last_value(CASE WHEN trusted THEN y END IGNORE NULLS) OVER w AS by_,
 first_value(CASE WHEN trusted THEN frame END IGNORE NULLS) OVER a AS af, first_value(CASE WHEN trusted THEN x END IGNORE NULLS) OVER a AS ax, first_value(CASE WHEN trusted THEN y END IGNORE NULLS) OVER a AS ay
 FROM p WINDOW w AS (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT recording_id, frame, CASE WHEN trusted THEN NULL ELSE 'UNSUPPORTED' END AS repair,
 round(CASE WHEN trusted THEN x WHEN bf IS NULL THEN ax WHEN af IS NULL THEN bx ELSE bx + (ax - bx) * ((frame - bf) / (af - bf)) END, 6) AS x_filled,
 round(CASE WHEN trusted THEN y WHEN bf IS NULL THEN ay WHEN af IS NULL THEN by_ ELSE by_ + (ay - by_) * ((frame - bf) / (af - bf)) END, 6) AS y_filled FROM b""")
def gap_fill_interpolate(spark, sf):
    p = poses(spark, sf).withColumn("trusted", F.col("event_type") != "error")
    return repair.fill(p).select("recording_id", "frame", "repair", *r6("x_filled", "y_filled"))


@query("SELECT recording_id, ceil(max(greatest(-(x - 250), 0)))::BIGINT + 1 AS \"left\", ceil(max(greatest(x - 250, 0)))::BIGINT + 1 AS \"right\", ceil(max(greatest(-y, 0)))::BIGINT + 1 AS top, ceil(max(greatest(y, 0)))::BIGINT + 1 AS bottom FROM @poses GROUP BY 1")
def crop_margin(spark, sf):
    return repair.crop_margin(poses(spark, sf).withColumn("x", F.col("x") - 250), 1)


@query(f"""WITH s AS (SELECT *, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0 FROM ({STEPS}) WINDOW w AS (PARTITION BY recording_id ORDER BY frame)),
t AS (SELECT *, sqrt((vx - lag(vx) OVER w) * (vx - lag(vx) OVER w) + (vy - lag(vy) OVER w) * (vy - lag(vy) OVER w)) AS acc, sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) AS reach FROM s WINDOW w AS (PARTITION BY recording_id ORDER BY frame))
SELECT recording_id, round(quantile_cont(step, 0.5), 6) AS median_step, round(quantile_cont(step, 0.9), 6) AS p90_step, round(max(step), 6) AS max_step, round(max(step) / greatest(quantile_cont(step, 0.5), 1e-9), 6) AS jump_ratio,
 round(arg_max(reach, frame) / greatest(sum(step), 1e-9), 6) AS path_efficiency, round(quantile_cont(acc, 0.5), 6) AS median_acceleration, round(quantile_cont(acc, 0.9), 6) AS p90_acceleration, round(max(acc), 6) AS max_acceleration, round(quantile_cont(reach, 0.9), 6) AS p90_reach
FROM t GROUP BY 1""")
def motion_features(spark, sf):
    m = repair.motion_features(poses(spark, sf))
    return m.select("recording_id", *r6(*[c for c in m.columns if c != "recording_id"]))


@query("SELECT recording_id, arg_min(frame, frame) AS start, round(any_value(span), 6) AS span FROM (SELECT *, max(span) OVER (PARTITION BY recording_id) AS best FROM (SELECT recording_id, frame, max(x) OVER w - min(x) OVER w AS span, count(*) OVER w AS n FROM @poses WINDOW w AS (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8) WHERE span = best GROUP BY 1")
def best_moving_window(spark, sf):
    return repair.best_window(poses(spark, sf), 8).select("recording_id", "start", *r6("span"))


@query(f"SELECT recording_id, CASE WHEN max(step) > 6 * quantile_cont(step, 0.5) THEN 'INTERMITTENT_JUMPS' WHEN abs(arg_max(x, frame) - arg_min(x, frame)) > 100 THEN 'STEADY_DIRECTIONAL_DRIFT' ELSE 'SUBPIXEL_RANDOM_WALK' END AS motion FROM ({STEPS}) GROUP BY 1")
def motion_type_label(spark, sf):
    s = repair.steps(poses(spark, sf)).groupBy("recording_id").agg(F.max("step").alias("top"), F.percentile("step", F.lit(0.5)).alias("mid"), (F.max_by("x", "frame") - F.min_by("x", "frame")).alias("net"))
    kind = F.when(F.col("top") > 6 * F.col("mid"), "INTERMITTENT_JUMPS").when(F.abs("net") > 100, "STEADY_DIRECTIONAL_DRIFT").otherwise("SUBPIXEL_RANDOM_WALK")
    return s.select("recording_id", kind.alias("motion"))


# --- analysis layer -----------------------------------------------------------------------------------------------


@query("""SELECT method, round(avg(m), 4) AS balanced_mean, count(*) AS kinds, sum(clusters)::BIGINT AS clusters FROM (SELECT method, kind, avg(m) AS m, count(*) AS clusters FROM (SELECT method, kind, cluster, avg(m) AS m FROM
 (SELECT method, kind, cluster, l_orderkey, avg(metric) AS m FROM @results GROUP BY ALL) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""")
def clustered_balanced_mean(spark, sf):
    m = analysis.balanced_mean(results(spark, sf), "metric", ["l_orderkey"], "cluster", "kind", ["method"])
    return m.select("method", F.round("balanced_mean", 4).alias("balanced_mean"), "kinds", "clusters")


@query("SELECT method, kind, round(avg(CASE WHEN l_discount < 0.08 THEN metric ELSE 9999.0 END), 4) AS scored, round(avg(CASE WHEN l_discount < 0.08 THEN 0.0 ELSE 1.0 END), 6) AS failure_rate FROM @results GROUP BY 1, 2")
def penalty_scored_metrics(spark, sf):
    ok = F.col("l_discount") < 0.08
    return results(spark, sf).groupBy("method", "kind").agg(F.round(F.avg(analysis.penalised(F.col("metric"), ok, F.lit(9999.0))), 4).alias("scored"), F.round(F.avg(F.when(ok, 0.0).otherwise(1.0)), 6).alias("failure_rate"))


@query("WITH m AS (SELECT kind, cluster, condition, avg(metric) AS m FROM @results GROUP BY 1, 2, 3) SELECT kind, count(*) AS pairs, round(avg(ln((s.m + 1e-6) / (c.m + 1e-6))), 6) AS degradation FROM m c JOIN m s USING (kind, cluster) WHERE c.condition = 'N' AND s.condition = 'R' GROUP BY 1")
def log_degradation(spark, sf):
    m = results(spark, sf).groupBy("kind", "cluster", "condition").agg(F.avg("metric").alias("m"))
    clean, stress = m.where("condition = 'N'").select("kind", "cluster", F.col("m").alias("c")), m.where("condition = 'R'").select("kind", "cluster", F.col("m").alias("s"))
    return clean.join(stress, ["kind", "cluster"]).groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(F.log((F.col("s") + 1e-6) / (F.col("c") + 1e-6))), 6).alias("degradation"))


@query("SELECT kind, round(avg(f - o), 4) AS difference, count(*) AS clusters FROM (SELECT kind, cluster, avg(metric) FILTER (method = 'F') AS f, avg(metric) FILTER (method = 'O') AS o FROM @results GROUP BY 1, 2) WHERE f IS NOT NULL AND o IS NOT NULL GROUP BY 1")
def paired_difference_pivot(spark, sf):
    p = results(spark, sf).groupBy("kind", "cluster").pivot("method", ["F", "O"]).agg(F.avg("metric"))
    return p.where("F IS NOT NULL AND O IS NOT NULL").groupBy("kind").agg(F.round(F.avg(F.col("F") - F.col("O")), 4).alias("difference"), F.count(F.lit(1)).alias("clusters"))


@query("SELECT kind, round(avg(metric) FILTER (condition = 'A'), 4) AS A, round(avg(metric) FILTER (condition = 'N'), 4) AS N, round(avg(metric) FILTER (condition = 'R'), 4) AS R FROM @results GROUP BY 1")
def panel_pivot(spark, sf):
    return results(spark, sf).groupBy("kind").pivot("condition", ["A", "N", "R"]).agg(F.round(F.avg("metric"), 4))


@query("WITH p AS (SELECT p_brand AS id, p_type AS family, round(min(p_retailprice) / 100000, 9) AS p FROM part GROUP BY 1, 2), a AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1) * p AS raw FROM p) SELECT id, family, round(least(1.0, max(raw) OVER (PARTITION BY family ORDER BY p, id)), 9) AS p_holm FROM a")
def holm_adjust(spark, sf):
    p = read(spark, sf, "part").groupBy(F.col("p_brand").alias("id"), F.col("p_type").alias("family")).agg(F.round(F.min("p_retailprice") / 100000, 9).alias("p"))
    return analysis.holm(p, "p", "id", ["family"]).select("id", "family", F.round("p_holm", 9).alias("p_holm"))


@query("WITH e AS (SELECT c_custkey AS cluster, p.k AS kind FROM customer, (SELECT DISTINCT o_orderpriority AS k FROM orders) p WHERE c_mktsegment = 'BUILDING'), a AS (SELECT DISTINCT o_custkey AS cluster, o_orderpriority AS kind FROM orders) SELECT *, 'missing' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'extra' FROM (SELECT * FROM a EXCEPT SELECT * FROM e)")
def completeness_gate(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderpriority").alias("kind"))
    c = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("cluster"))
    grid = c.crossJoin(o.select("kind").distinct())  # the expected grid itself: clusters by the few kinds
    return analysis.completeness(o, grid, ["cluster", "kind"])


@query("SELECT l_orderkey, l_partkey, count(*) AS rows, count(DISTINCT (l_suppkey, l_quantity)) AS variants FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT (l_suppkey, l_quantity)) > 1")
def conflict_duplicates(spark, sf):
    return analysis.conflicts(read(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"], ["l_suppkey", "l_quantity"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def dedup_keep_first(spark, sf):
    return analysis.first_per_group(read(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("WITH s AS (SELECT kind, condition, method, round(avg(CASE WHEN l_discount < 0.08 THEN 0.0 ELSE 1.0 END), 6) AS failures, round(quantile_cont(metric, 0.5), 4) AS med FROM @results GROUP BY 1, 2, 3) SELECT kind, condition, method, failures, med FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY failures, med, condition, method) AS r FROM s) WHERE r = 1")
def config_winner_tiebreak(spark, sf):
    s = results(spark, sf).groupBy("kind", "condition", "method").agg(F.round(F.avg(F.when(F.col("l_discount") < 0.08, 0.0).otherwise(1.0)), 6).alias("failures"), F.round(F.percentile("metric", F.lit(0.5)), 4).alias("med"))
    return analysis.first_per_group(s, ["kind"], ["failures", "med", "condition", "method"])


@query("WITH s AS (SELECT o_orderpriority AS channel, o_orderstatus AS method, round(avg(o_totalprice), 2) AS error, count(*) AS time FROM orders GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY channel ORDER BY error, method) AS error_rank, row_number() OVER (PARTITION BY channel ORDER BY time, method) AS time_rank FROM s")
def rank_error_and_time(spark, sf):
    s = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("channel"), F.col("o_orderstatus").alias("method")).agg(F.round(F.avg("o_totalprice"), 2).alias("error"), F.count(F.lit(1)).alias("time"))
    w = Window.partitionBy("channel")
    return s.withColumn("error_rank", F.row_number().over(w.orderBy("error", "method"))).withColumn("time_rank", F.row_number().over(w.orderBy("time", "method")))


@query("SELECT h.n_name AS held_out, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance FROM customer c JOIN nation n ON c_nationkey = n.n_nationkey JOIN nation h ON h.n_nationkey <> n.n_nationkey GROUP BY 1")
def leave_one_group_out(spark, sf):
    nation = read(spark, sf, "nation")
    per = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    tot = per.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    held = nation.join(per, nation.n_nationkey == per.c_nationkey, "left").crossJoin(tot)  # one row of totals
    n, s = F.coalesce("n", F.lit(0)), F.coalesce("s", F.lit(0.0))
    return held.select(F.col("n_name").alias("held_out"), (F.col("tn") - n).alias("n"), F.round((F.col("ts") - s) / (F.col("tn") - n), 4).alias("mean_balance"))


@query("SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(c_custkey::VARCHAR), c_custkey) AS r FROM customer) WHERE r <= 50")
def hash_sample_head(spark, sf):
    c = read(spark, sf, "customer").withColumn("h", F.sha2(F.col("c_custkey").cast("string"), 256))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("h", "c_custkey"))).where("r <= 50").select("c_mktsegment", "c_custkey")


@query("SELECT coalesce(kind, 'ALL') AS kind, method, count(*) AS n, round(avg(metric), 4) AS m FROM @results GROUP BY GROUPING SETS ((kind, method), (method))")
def rollup_all_vs_class(spark, sf):
    # each row once for its kind and once for all: a relabelled copy, as a grouping set makes it
    r = results(spark, sf).select("method", "metric", F.explode(F.array("kind", F.lit("ALL"))).alias("kind"))
    return r.groupBy("kind", "method").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("metric"), 4).alias("m"))


@query("SELECT kind, count(*) AS n, round(max(d), 2) AS largest FROM (SELECT CASE WHEN b.k IS NULL THEN 'only_first' WHEN a.k IS NULL THEN 'only_second' WHEN a.v = b.v THEN 'equal' ELSE 'different' END AS kind, abs(a.v - b.v) AS d FROM (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'P') a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderstatus <> 'F') b ON a.k = b.k) GROUP BY 1")
def replay_mismatch(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").alias("v"))
    b = o.where("o_orderstatus <> 'F'").withColumn("v", F.when(F.col("o_orderpriority") == "5-LOW", F.col("v") + 1).otherwise(F.col("v")))
    return analysis.compare(o.where("o_orderstatus <> 'P'"), b, ["o_orderkey"], "v").withColumn("largest", F.round("largest", 2))


@query("SELECT user_id, frame, round(error, 6) AS error FROM (SELECT user_id, unnest(range(len(v))) AS frame, unnest(list_transform(v, lambda x: abs(x - 250))) AS error FROM (SELECT user_id, list_transform(string_split(string_agg(value::VARCHAR, ';' ORDER BY ts, event_id), ';'), lambda s: s::DOUBLE) AS v FROM events GROUP BY 1))")
def trajectory_string_parse(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("l"))
    s = e.select("user_id", F.array_join(F.transform("l", lambda x: x["value"].cast("string")), ";").alias("s"))
    return s.select("user_id", F.posexplode(stats.parse_series(F.col("s"))).alias("frame", "x")).select("user_id", F.col("frame").cast("long"), F.round(F.abs(F.col("x") - 250), 6).alias("error"))


@query(r"SELECT p_partkey, trim(regexp_replace(upper(trim(p_name)), '[^A-Z0-9]+', '_', 'g'), '_') AS name, regexp_extract(p_brand, '^([^#]*)#', 1) AS prefix, sha256(p_name) AS digest FROM part")
def enum_normalise(spark, sf):
    return read(spark, sf, "part").select("p_partkey", stats.enum_name(F.col("p_name")).alias("name"), F.substring_index("p_brand", "#", 1).alias("prefix"), F.sha2("p_name", 256).alias("digest"))


# --- registration: numeric kernels, held against fixtures in the tests --------------------------------------------


@query()
def registration_report(spark, sf):
    """Register every recording and report how well it went."""
    from driftlake import engine
    from driftlake.kernels.fit import Options

    p = planes(spark, sf).select("recording_id", F.col("frame").cast("int").alias("frame"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("plane").alias("pixels"))
    trajectory, pairs = engine.estimate(p, Options(max_shift=2.0))
    rep = engine.report(trajectory, pairs)
    return rep.select("recording_id", "frames", "repaired", "pairs", "refused", "not_converged", "at_bound", *[F.round(c, 5).alias(c) for c in ("largest_move", "residual_before", "residual_after")])


@query()
def robust_trajectory(spark, sf):
    """Poses by the robust graph solution, repaired."""
    from driftlake import engine
    from driftlake.kernels.fit import Options

    p = planes(spark, sf).select("recording_id", F.col("frame").cast("int").alias("frame"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("plane").alias("pixels"))
    t, _ = engine.estimate(p, Options(max_shift=2.0), weighting="ROBUST")
    return t.select("recording_id", "frame", *[F.round(c, 5).alias(c) for c in ("dx", "dy", "theta")], "support", "repair")


# --- recipes, evidence and further windows ------------------------------------------------------------------------


@query("""SELECT image, motion, norm, rotation_gain FROM (VALUES
 ('PHASE_CONTRAST','CURVED_OSCILLATING_DRIFT','LEAST_SQUARES',0.01::DOUBLE),('PHASE_CONTRAST','STEADY_DIRECTIONAL_DRIFT','TUKEY',0.01),('PHASE_CONTRAST','SUBPIXEL_RANDOM_WALK','HUBER',0.01),('PHASE_CONTRAST','INTERMITTENT_JUMPS','HUBER',0.01),
 ('BRIGHTFIELD_DIC','CURVED_OSCILLATING_DRIFT','HUBER',0.001),('BRIGHTFIELD_DIC','STEADY_DIRECTIONAL_DRIFT','LEAST_SQUARES',0.001),('BRIGHTFIELD_DIC','SUBPIXEL_RANDOM_WALK','HUBER',0.001),('BRIGHTFIELD_DIC','INTERMITTENT_JUMPS','LEAST_SQUARES',0.001),
 ('DENSE_FLUORESCENCE','CURVED_OSCILLATING_DRIFT','TUKEY',0.002),('DENSE_FLUORESCENCE','STEADY_DIRECTIONAL_DRIFT','HUBER',0.002),('DENSE_FLUORESCENCE','SUBPIXEL_RANDOM_WALK','TUKEY',0.002),('DENSE_FLUORESCENCE','INTERMITTENT_JUMPS','TUKEY',0.002),
 ('SPARSE_LOW_LIGHT_FLUORESCENCE','CURVED_OSCILLATING_DRIFT','TUKEY',0.01),('SPARSE_LOW_LIGHT_FLUORESCENCE','STEADY_DIRECTIONAL_DRIFT','TUKEY',0.01),('SPARSE_LOW_LIGHT_FLUORESCENCE','SUBPIXEL_RANDOM_WALK','TUKEY',0.01),('SPARSE_LOW_LIGHT_FLUORESCENCE','INTERMITTENT_JUMPS','TUKEY',0.01),
 ('FIDUCIAL_STATIC','CURVED_OSCILLATING_DRIFT','LEAST_SQUARES',0.005),('FIDUCIAL_STATIC','STEADY_DIRECTIONAL_DRIFT','TUKEY',0.005),('FIDUCIAL_STATIC','SUBPIXEL_RANDOM_WALK','HUBER',0.005),('FIDUCIAL_STATIC','INTERMITTENT_JUMPS','LEAST_SQUARES',0.005)) t(image, motion, norm, rotation_gain)""")
def recommendation_matrix(spark, sf):
    from driftlake.operators.recipes import matrix

    return matrix(spark).select("image", "motion", "norm", "rotation_gain")


@query(f"SELECT recording_id, count(*) AS pairs, round(list_sort(list(residual_after))[floor(count(*) / 2)::INT + 1], 6) AS median_after, round(quantile_cont(residual_after, 0.9), 6) AS p90_after, round(avg(CASE WHEN residual_after < residual_before - 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS improved, round(max(abs(log_gain)), 6) AS largest_gain FROM (SELECT recording_id, log_gain, list_avg(list_transform(d, lambda x: abs(x))) AS residual_before, list_avg(list_transform(r, lambda x: abs(x))) AS residual_after FROM ({RESID})) GROUP BY 1")
def reconciliation_evidence(spark, sf):
    p = _pairs(spark, sf).select("recording_id", "log_gain", F.round("residual_before", 12).alias("residual_before"), F.round("residual_after", 12).alias("residual_after"))
    return p.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.round(stats.upper_median(F.collect_list("residual_after")), 6).alias("median_after"), F.round(F.percentile("residual_after", F.lit(0.9)), 6).alias("p90_after"),
        F.round(F.avg(F.when(F.col("residual_after") < F.col("residual_before") - 1e-9, 1.0).otherwise(0.0)), 6).alias("improved"), F.round(F.max(F.abs("log_gain")), 6).alias("largest_gain"),
    )


@query(f"WITH g AS (SELECT recording_id, to_frame AS frame, log_gain FROM ({GAINED}) WHERE lag = 1), f AS (SELECT recording_id, frame FROM @planes) SELECT f.recording_id, f.frame, round(sum(coalesce(log_gain, 0)) OVER (PARTITION BY f.recording_id ORDER BY f.frame), 5) AS log2_gain FROM f LEFT JOIN g USING (recording_id, frame)")
def running_gain(spark, sf):
    p = planes(spark, sf)
    own = pixels.pair_residuals(planning.multilag(p, (1,)), p).select("recording_id", F.col("to_frame").alias("frame"), "log_gain")
    w = Window.partitionBy("recording_id").orderBy("frame")
    return p.select("recording_id", "frame").join(own, ["recording_id", "frame"], "left").select("recording_id", "frame", F.round(F.sum(F.coalesce("log_gain", F.lit(0.0))).over(w), 5).alias("log2_gain"))


@query("SELECT recording_id, frame, round(abs(list_sort(list(x) OVER b)[len(list(x) OVER b) // 2 + 1] - list_sort(list(x) OVER a)[len(list(x) OVER a) // 2 + 1]), 6) AS jump FROM @poses WINDOW b AS (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)")
def rolling_median_sides(spark, sf):
    w = Window.partitionBy("recording_id").orderBy("frame")
    side = lambda lo, hi: stats.upper_median(F.collect_list("x").over(w.rowsBetween(lo, hi)))
    return poses(spark, sf).select("recording_id", "frame", F.round(F.abs(side(-6, -1) - side(0, 5)), 6).alias("jump"))


@query("SELECT recording_id, frame, round(sum(CASE WHEN event_type = 'error' THEN 0.01 * y ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY frame), 6) AS angle FROM @poses")
def piecewise_angle_cumsum(spark, sf):
    w = Window.partitionBy("recording_id").orderBy("frame")
    return poses(spark, sf).select("recording_id", "frame", F.round(F.sum(F.when(F.col("event_type") == "error", 0.01 * F.col("y")).otherwise(0.0)).over(w), 6).alias("angle"))


@query("SELECT recording_id, round(atan2(sum(w * sin(x / 100)), sum(w * cos(x / 100))), 6) AS mean_angle, round(sqrt(pow(sum(w * sin(x / 100)), 2) + pow(sum(w * cos(x / 100)), 2)) / sum(w), 6) AS concentration FROM (SELECT *, 1 / (1 + y) AS w FROM @poses) GROUP BY 1")
def circular_weighted_mean(spark, sf):
    p = poses(spark, sf).withColumn("w", 1 / (1 + F.col("y")))
    s, c = F.sum(F.col("w") * F.sin(F.col("x") / 100)), F.sum(F.col("w") * F.cos(F.col("x") / 100))
    return p.groupBy("recording_id").agg(F.round(F.atan2(s, c), 6).alias("mean_angle"), F.round(F.sqrt(s * s + c * c) / F.sum("w"), 6).alias("concentration"))


@query("SELECT recording_id, frame, round(m, 6) AS consensus, n FROM (SELECT recording_id, frame // 4 AS frame, quantile_cont(x, 0.5) AS m, count(*) AS n FROM @poses GROUP BY 1, 2)")
def channel_consensus(spark, sf):
    p = poses(spark, sf).groupBy("recording_id", F.floor(F.col("frame") / 4).alias("frame"))
    return p.agg(F.round(F.percentile("x", F.lit(0.5)), 6).alias("consensus"), F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, done, total, (hundredths * (total - done)) // done AS eta_hundredths FROM (SELECT user_id, row_number() OVER w AS done, count(*) OVER (PARTITION BY user_id) AS total, sum(round(value * 100)::BIGINT) OVER w AS hundredths FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))".replace("sum(round(value * 100)::BIGINT) OVER w", "(sum(round(value * 100)::BIGINT) OVER w)::BIGINT"))
def eta_remaining(spark, sf):
    """Mean of what is done by what is left, in whole hundredths of a second."""
    w, a = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id")
    spent = F.sum(F.round(F.col("value") * 100).cast("long")).over(w)
    e = read(spark, sf, "events").select("user_id", F.row_number().over(w).alias("done"), F.count(F.lit(1)).over(a).alias("total"), spent.alias("spent"))
    return e.select("user_id", "done", "total", F.expr("(spent * (total - done)) div done").alias("eta_hundredths"))


@query(r"SELECT event_id, regexp_extract(props, '\"([a-z]+)\"', 1) AS option, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k, regexp_matches(props, '(?i)\b(nan|inf|infinity)\b') AS nonfinite FROM events")
def options_string_parse(spark, sf):
    e = read(spark, sf, "events")
    return e.select("event_id", F.regexp_extract("props", '"([a-z]+)"', 1).alias("option"), F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.col("props").rlike(r"(?i)\b(nan|inf|infinity)\b").alias("nonfinite"))


@query("SELECT condition, method, count(*) AS n FROM (SELECT condition, method FROM @results UNION ALL SELECT 'ALL', method FROM @results) GROUP BY 1, 2")
def union_views(spark, sf):
    r = results(spark, sf).select("condition", "method")
    return r.unionByName(r.withColumn("condition", F.lit("ALL"))).groupBy("condition", "method").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, round(max(0.02, 0.25 * avg(m)), 6) AS margin FROM (SELECT kind, cluster, avg(metric) AS m FROM @results GROUP BY 1, 2) GROUP BY 1".replace("max(0.02,", "greatest(0.02,"))
def noninferiority_margin(spark, sf):
    m = results(spark, sf).groupBy("kind", "cluster").agg(F.avg("metric").alias("m"))
    return m.groupBy("kind").agg(F.round(F.greatest(F.lit(0.02), 0.25 * F.avg("m")), 6).alias("margin"))


@query("SELECT family, round(least(1.0, 3 * p), 9) AS p_conjunction FROM (SELECT p_type AS family, round(p_retailprice / 100000, 9) AS p, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS r FROM part) WHERE r = 3")
def partial_conjunction(spark, sf):
    w = Window.partitionBy("p_type").orderBy("p_retailprice", "p_partkey")
    p = read(spark, sf, "part").withColumn("r", F.row_number().over(w)).where("r = 3")
    return p.select(F.col("p_type").alias("family"), F.round(F.least(F.lit(1.0), 3 * F.round(F.col("p_retailprice") / 100000, 9)), 9).alias("p_conjunction"))


@query("SELECT o_orderkey, count(*) AS pairs, round(quantile_cont(l_discount, 0.5), 6) AS median, round(quantile_cont(l_discount, 0.9), 6) AS p90, max(l_discount) AS worst, sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END)::BIGINT AS refused FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def pair_to_recording(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount")
    j = li.join(read(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    return j.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.percentile("l_discount", F.lit(0.5)), 6).alias("median"), F.round(F.percentile("l_discount", F.lit(0.9)), 6).alias("p90"), F.max("l_discount").alias("worst"), F.count_if(F.col("l_discount") > 0.08).alias("refused"))
