"""Registered queries of evidence, choices and benchmark evaluation, and the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlake.operators import benchmark, evidence, pixels, planning
from driftlake.operators.repair import so_far
from driftlake.plans.catalog import query, r6
from driftlake.plans.tables import frames, planes, poses, read, results

#: Pairs at lag 1 and 2 with a status and residuals made from their ids, and the same in DuckDB.
PAIRS_SQL = """SELECT recording_id, frame AS from_frame, frame + lag AS to_frame, lag, frame * 2 + lag - 1 AS plan_index,
  CASE (frame * 7 + lag * 3) % 11 WHEN 0 THEN 'REFUSED_LOW_OVERLAP' WHEN 1 THEN 'AT_SHIFT_BOUND' WHEN 2 THEN 'NOT_CONVERGED'
    WHEN 3 THEN 'AT_SHIFT_AND_ROTATION_BOUND' ELSE 'OK' END AS status,
  (frame % 13) / 10.0 AS residual_before, (frame % 5) / 10.0 AS residual_after
  FROM @planes, (SELECT unnest([1, 2]) AS lag) WHERE frame + lag <= 60"""


def _pairs(spark, sf):
    p = frames(spark, sf).withColumn("lag", F.explode(F.array(F.lit(1), F.lit(2)))).where("frame + lag <= 60")
    k = (F.col("frame") * 7 + F.col("lag") * 3) % 11
    status = F.when(k == 0, "REFUSED_LOW_OVERLAP").when(k == 1, "AT_SHIFT_BOUND").when(k == 2, "NOT_CONVERGED").when(k == 3, "AT_SHIFT_AND_ROTATION_BOUND").otherwise("OK")
    return p.select(
        "recording_id", F.col("frame").alias("from_frame"), (F.col("frame") + F.col("lag")).alias("to_frame"), "lag", (F.col("frame") * 2 + F.col("lag") - 1).alias("plan_index"),
        status.alias("status"), ((F.col("frame") % 13) / 10.0).alias("residual_before"), ((F.col("frame") % 5) / 10.0).alias("residual_after"),
    )


OWNERS_SQL = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, to_frame ORDER BY lag, plan_index) AS r FROM ({PAIRS_SQL})) WHERE r = 1"""


def _owned(spark, sf):
    p = _pairs(spark, sf)
    return planning.owners(p).select("recording_id", "plan_index").join(p, ["recording_id", "plan_index"])


@query("""WITH n AS (SELECT recording_id, max(frame) AS last FROM @planes GROUP BY 1),
  g AS (SELECT DISTINCT recording_id, last, gap FROM (SELECT recording_id, last, unnest(list_append(list_filter(list_transform(range(19), lambda k: (3 ** k)::INT), lambda g: g <= last), last)) AS gap FROM n WHERE last > 0))
  SELECT DISTINCT recording_id, gap::INT AS gap, (t - gap)::INT AS from_frame, t::INT AS to_frame
  FROM (SELECT recording_id, gap, unnest(list_append(range(gap, last + 1, gap), last)) AS t FROM g)""")
def pair_plan_multi_scale(spark, sf):
    return planning.multi_scale(frames(spark, sf))


@query("""SELECT 'LOG_RATIO_FIT' AS estimator, support, band, floor, ceiling, filter, mask FROM (VALUES ('ALL'), ('GRADIENT'), ('MUTUAL_NOISE_GRADIENT')) s(support),
  (VALUES ('full', NULL, NULL), ('no_top_10', NULL, 90.0), ('no_top_25', NULL, 75.0), ('no_bottom_25', 25.0, NULL)) b(band, floor, ceiling),
  (VALUES ('NONE'), ('GAUSSIAN_0_7'), ('GAUSSIAN_1_0'), ('MEDIAN_3X3')) f(filter), (VALUES ('NONE'), ('LEAST_INFORMATIVE_25')) m(mask)
  UNION ALL SELECT e, 'ALL', band, floor, ceiling, filter, 'NONE' FROM (VALUES ('AREA_CORRELATION'), ('AREA_CORRELATION_NEWTON')) s(e),
  (VALUES ('full', NULL, NULL), ('no_top_10', NULL, 90.0), ('no_top_25', NULL, 75.0), ('no_bottom_25', 25.0, NULL)) b(band, floor, ceiling),
  (VALUES ('NONE'), ('GAUSSIAN_0_7'), ('GAUSSIAN_1_0'), ('MEDIAN_3X3')) f(filter)""")
def recipe_grid(spark, sf):
    return evidence.recipe_grid(spark)


@query(f"""SELECT recording_id, to_frame AS frame, status <> 'REFUSED_LOW_OVERLAP' AND (status = 'OK' OR residual_before - residual_after >= 0.45) AS protected FROM ({OWNERS_SQL})""")
def outlier_protection(spark, sf):
    return evidence.protected(_owned(spark, sf), 0.45).select("recording_id", F.col("to_frame").alias("frame"), "protected")


@query(f"""WITH o AS ({OWNERS_SQL}), p AS ({PAIRS_SQL}),
  a AS (SELECT recording_id, count(*) FILTER (status IN ('AT_SHIFT_BOUND', 'AT_SHIFT_AND_ROTATION_BOUND')) AS s, count(*) FILTER (status = 'AT_SHIFT_AND_ROTATION_BOUND') AS t FROM o GROUP BY 1),
  b AS (SELECT recording_id, count(*) FILTER (status = 'REFUSED_LOW_OVERLAP') AS r, count(*) AS n FROM p GROUP BY 1)
  SELECT * FROM (SELECT recording_id, 'AT_SHIFT_BOUND' AS kind, s AS n, s || ' frame(s) ended on the 30.0 px maximum-shift bound' AS message FROM a
  UNION ALL SELECT recording_id, 'AT_ROTATION_BOUND', t, t || ' frame(s) ended on the 10.00 degree maximum-rotation bound' FROM a
  UNION ALL SELECT recording_id, 'REFUSED_PAIRS', r, r || ' of ' || n || ' pairs had too few usable pixels and were refused' FROM b) WHERE n > 0""")
def frame_warnings(spark, sf):
    return evidence.warnings(_owned(spark, sf), _pairs(spark, sf), 30.0, 10.0)


def _influences(spark, sf):
    p = _pairs(spark, sf).where("status <> 'REFUSED_LOW_OVERLAP'")
    return p.select("recording_id", "plan_index", F.greatest(F.lit(0.05), 1 - (F.col("from_frame") % 4) / 2.5).alias("factor"), (F.col("from_frame") % 6 == 0).alias("fallback"))


INFLUENCES_SQL = f"""SELECT recording_id, plan_index, greatest(0.05::DOUBLE, 1 - (from_frame % 4) / 2.5::DOUBLE) AS factor, from_frame % 6 = 0 AS fallback FROM ({PAIRS_SQL}) WHERE status <> 'REFUSED_LOW_OVERLAP'"""


@query(f"""SELECT p.recording_id, p.plan_index, round(i.factor, 6) AS factor, i.factor IS NOT NULL AS used, CASE WHEN i.factor IS NULL THEN 'not_used' ELSE 'used' END AS influence
  FROM ({PAIRS_SQL}) p LEFT JOIN ({INFLUENCES_SQL}) i USING (recording_id, plan_index)""")
def attach_influences(spark, sf):
    return evidence.with_influences(_pairs(spark, sf), _influences(spark, sf)).select("recording_id", "plan_index", *r6("factor"), "used", "influence")


@query(f"""SELECT recording_id, count(*) AS used, count(*) FILTER (factor < 1) AS down_weighted, count(*) FILTER (factor <= 0.05 + 1e-15) AS at_least_weight, count(*) FILTER (fallback) AS unavailable FROM ({INFLUENCES_SQL}) GROUP BY 1""")
def quality_counters(spark, sf):
    return evidence.counters(_influences(spark, sf).withColumn("used", F.lit(True)))


def _turned(spark, sf):
    return poses(spark, sf).select("recording_id", "frame", "x", "y", (F.col("frame") % 9 / 40.0).alias("theta"))


@query("""WITH p AS (SELECT recording_id, frame, x, y, frame % 9 / 40.0::DOUBLE AS theta FROM @poses), a AS (SELECT * FROM p WHERE frame = 2)
  SELECT p.recording_id, p.frame, round(p.x - (cos(p.theta - a.theta) * a.x - sin(p.theta - a.theta) * a.y), 6) AS x,
  round(p.y - (sin(p.theta - a.theta) * a.x + cos(p.theta - a.theta) * a.y), 6) AS y, round(p.theta - a.theta, 6) AS theta FROM p JOIN a USING (recording_id)""")
def rebase_trajectory(spark, sf):
    anchor = frames_of_poses(spark, sf).where("frame = 2")
    return evidence.rebase(_turned(spark, sf), anchor).select("recording_id", "frame", *r6("x", "y", "theta"))


def frames_of_poses(spark, sf):
    return poses(spark, sf).select("recording_id", "frame")


@query("""SELECT p.recording_id, p.frame, round(p.x * 2.0, 6) AS x, round(p.y * 2.0, 6) AS y, round((p.frame // 3) * 0.05::DOUBLE, 6) AS theta FROM @poses p""")
def known_angle_projection(spark, sf):
    angles = frames_of_poses(spark, sf).select("recording_id", "frame", (F.floor(F.col("frame") / 3) * 0.05).alias("known"))
    p = poses(spark, sf).join(angles, ["recording_id", "frame"])
    return p.select("recording_id", "frame", F.round(F.col("x") * 2.0, 6).alias("x"), F.round(F.col("y") * 2.0, 6).alias("y"), F.round("known", 6).alias("theta"))


@query("""WITH p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py,
    median(x) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS lx, median(y) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ly,
    median(x) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS rx, median(y) OVER (PARTITION BY recording_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ry
    FROM @poses WINDOW w AS (PARTITION BY recording_id ORDER BY frame))
  SELECT recording_id, frame, round(sqrt((x - px) ** 2 + (y - py) ** 2), 6) AS step, round(sqrt((rx - lx) ** 2 + (ry - ly) ** 2), 6) AS move FROM p
  WHERE sqrt((x - px) ** 2 + (y - py) ** 2) >= 2 AND sqrt((rx - lx) ** 2 + (ry - ly) ** 2) >= 2""")
def jump_trace_cuts(spark, sf):
    return evidence.jump_cuts(poses(spark, sf)).select("recording_id", "frame", *r6("step", "move"))


def _scores(spark, sf):
    return poses(spark, sf).select("recording_id", "frame", (F.col("x") % 100 / 100.0).alias("score"))


@query("""WITH s AS (SELECT recording_id, frame, x % 100 / 100.0 AS score FROM @poses), m AS (SELECT *, median(score) OVER (PARTITION BY recording_id) AS med FROM s),
  f AS (SELECT *, greatest(0.18, least(0.50, med - 2.5 * 1.4826 * median(abs(score - med)) OVER (PARTITION BY recording_id))) AS floor FROM m)
  SELECT recording_id, frame, round(greatest(0.0, least(1.0, (score - floor) / greatest(med - floor, 0.05))), 6) AS confidence FROM f""")
def score_confidence(spark, sf):
    return evidence.confidence(_scores(spark, sf)).select("recording_id", "frame", *r6("confidence"))


@query("""WITH s AS (SELECT recording_id, frame, x % 100 / 100.0 AS score FROM @poses), m AS (SELECT *, least(0.20, 0.35 * median(score) OVER (PARTITION BY recording_id)) AS cut FROM s)
  SELECT recording_id, frame, round(score, 6) AS score FROM m WHERE score < cut""")
def low_confidence_boundaries(spark, sf):
    return evidence.weak_boundaries(_scores(spark, sf), "score").select("recording_id", "frame", *r6("score"))


@query("""WITH l AS (SELECT recording_id, frame, list_aggregate(plane, 'max')::DOUBLE AS light, list_aggregate(plane, 'max')::DOUBLE - list_aggregate(plane, 'min')::DOUBLE AS structure FROM @planes),
  u AS (SELECT *, structure >= greatest(1e-6, 0.35 * median(structure) OVER (PARTITION BY recording_id)) AS ok FROM l),
  k AS (SELECT * FROM (SELECT *, sum(ok::INT) OVER (PARTITION BY recording_id) AS n FROM u) WHERE ok OR n < 4),
  r AS (SELECT recording_id, frame, row_number() OVER (PARTITION BY recording_id ORDER BY light DESC, frame) AS b, row_number() OVER (PARTITION BY recording_id ORDER BY light, frame) AS d FROM k)
  SELECT recording_id, max(frame) FILTER (b = 1) AS bright, max(frame) FILTER (d = 1) AS dim FROM r GROUP BY 1""")
def reference_choice(spark, sf):
    top, low = F.array_max("plane").cast("double"), F.array_min("plane").cast("double")
    return evidence.reference_frames(planes(spark, sf).select("recording_id", "frame", top.alias("light"), (top - low).alias("structure")))


@query("""WITH s AS (SELECT recording_id, frame, list_sort(plane) AS s FROM @planes), v AS (SELECT recording_id, frame,
    (s[len(s) // 2 + 1] - s[floor(0.01 * (len(s) - 1) + 0.5)::INT + 1])::DOUBLE / greatest(1e-9, (s[floor(0.99 * (len(s) - 1) + 0.5)::INT + 1] - s[floor(0.01 * (len(s) - 1) + 0.5)::INT + 1])::DOUBLE) AS sparse FROM s)
  SELECT recording_id, frame, round(sparse, 4) AS sparse, CASE WHEN frame % 17 = 0 THEN 'EXPLICIT_INTENSITY_BAND' WHEN sparse < 0.50 THEN 'SPARSE_MUTUAL_NOISE_EDGES'
    WHEN frame % 4 > 1.55 THEN 'MOVING_STANDARD_GRADIENT' ELSE 'STABLE_EXCLUDE_BRIGHTEST_TEN_PERCENT' END AS choice FROM v WHERE abs(sparse - 0.5) > 1e-5""")
def information_selector(spark, sf):
    s = planes(spark, sf).withColumn("sparse", evidence.sparse_score(F.col("plane")).cast("double")).where("abs(sparse - 0.5) > 1e-5")
    c = evidence.information_choice(F.col("sparse"), (F.col("frame") % 4).cast("double"), F.col("frame") % 17 == 0)
    return s.select("recording_id", "frame", F.round("sparse", 4).alias("sparse"), c.alias("choice"))


@query("""SELECT recording_id, (event_type = 'click')::INT AS event_type_is_click, (event_type = 'view')::INT AS event_type_is_view, (event_type = 'purchase')::INT AS event_type_is_purchase, count(*) AS n FROM @poses GROUP BY ALL""")
def one_hot_types(spark, sf):
    p = evidence.one_hot(poses(spark, sf), "event_type", ("click", "view", "purchase"))
    return p.groupBy("recording_id", "event_type_is_click", "event_type_is_view", "event_type_is_purchase").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT recording_id, count(*) AS n, min(x) AS low, max(x) AS high, 8 + recording_id % 20 AS side FROM @poses GROUP BY 1)
  SELECT recording_id, CASE WHEN n < 2 THEN 'fewer than two guide frames' WHEN side < 16 THEN 'guide plane smaller than 16x16'
    WHEN NOT coalesce(high > low, false) THEN 'no finite positive raw-image dynamic range' ELSE '' END AS reason FROM f""")
def evidence_validity(spark, sf):
    side = 8 + F.col("recording_id") % 20
    f = poses(spark, sf).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    return f.select("recording_id", evidence.evidence_reason(F.col("n"), side, side, F.col("low"), F.col("high")).alias("reason"))


def _features(spark, sf):
    # means that add up by frame: a mean that meets a threshold or another gain must not hang on how rows are dealt to tasks
    means = poses(spark, sf).select("recording_id", "frame", "x", F.avg("x").over(so_far()).alias("fx"), F.avg("y").over(so_far()).alias("fy"))
    return means.groupBy("recording_id").agg(F.max_by("fx", "frame").alias("fx"), F.max_by("fy", "frame").alias("fy"), F.max("x").alias("top"))


GAIN_MODEL = [("area", "", 0.5), ("area", "fx", 0.002), ("area", "fy", -0.1), ("log", "", 0.2), ("log", "top", 0.0007), ("newton", "", 0.4), ("newton", "fx", 0.003)]


@query("""WITH f AS (SELECT recording_id, avg(x) AS fx, avg(y) AS fy, max(x) AS top FROM @poses GROUP BY 1),
  g AS (SELECT recording_id, 'area' AS candidate, 1 AS place, 0.5 + 0.002 * fx - 0.1 * fy AS gain FROM f UNION ALL SELECT recording_id, 'log', 2, 0.2 + 0.0007 * top FROM f UNION ALL SELECT recording_id, 'newton', 3, 0.4 + 0.003 * fx FROM f)
  SELECT recording_id, candidate, round(gain, 6) AS gain, gain < 0.9 AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY gain DESC, place DESC) AS r FROM g) WHERE r = 1""")
def linear_gain_selection(spark, sf):
    model = spark.createDataFrame(GAIN_MODEL, "candidate string, feature string, weight double")
    g = evidence.linear_gains(_features(spark, sf), ["fx", "fy", "top"], model).withColumn("place", F.when(F.col("candidate") == "area", 1).when(F.col("candidate") == "log", 2).otherwise(3))
    return evidence.best_gain(g, ["recording_id"], 0.9).select("recording_id", "candidate", *r6("gain"), "fallback")


@query("""WITH f AS (SELECT recording_id, avg(x) AS fx, avg(y) AS fy, max(x) AS top FROM @poses GROUP BY 1),
  z AS (SELECT recording_id, (fx - 250) / 10 AS a, (fy - 3) / 0.2 AS b, top = 500 AS same FROM f)
  SELECT recording_id, NOT (abs(a) > 8 OR abs(b) > 8 OR NOT same) AND sqrt((a * a + b * b) / 2) <= 3 AS in_distribution, round(sqrt((a * a + b * b) / 2), 6) AS rms_z FROM z""")
def selector_in_distribution(spark, sf):
    model = spark.createDataFrame([("fx", 250.0, 10.0), ("fy", 3.0, 0.2), ("top", 500.0, 0.0)], "feature string, mean double, scale double")
    return evidence.in_distribution(_features(spark, sf), ["fx", "fy", "top"], model).select("recording_id", "in_distribution", *r6("rms_z"))


@query("""WITH p AS (SELECT recording_id, frame, unnest(range(64)) AS i, unnest(plane)::DOUBLE AS v FROM @planes WHERE frame < 40), q AS (SELECT recording_id, frame, i // 8 AS y, i % 8 AS x, v FROM p),
  m AS (SELECT a.recording_id, a.frame, a.y, a.x, a.v, max(b.v) AS most FROM q a JOIN q b ON a.recording_id = b.recording_id AND a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL)
  SELECT recording_id, frame, r AS peak, y, x, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, frame ORDER BY v DESC, y, x) AS r FROM m WHERE v >= most) WHERE r <= 3""")
def strongest_local_peaks(spark, sf):
    p = pixels.explode_pixels(planes(spark, sf).where("frame < 40"), 8)
    return evidence.local_peaks(p, 3).select("recording_id", "frame", "peak", "y", "x", *r6("v"))


@query("""WITH c AS (SELECT o_custkey AS cluster, max(o_orderpriority) AS priority FROM orders GROUP BY 1)
  SELECT r.l_orderkey, r.l_linenumber, c.priority FROM @results r LEFT JOIN (SELECT * FROM c WHERE cluster % 3 <> 0) c USING (cluster)""")
def left_join_cardinality(spark, sf):
    c = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.max("o_orderpriority").alias("priority")).where("cluster % 3 <> 0")
    return benchmark.left_join_one(results(spark, sf), c, ["cluster"]).select("l_orderkey", "l_linenumber", "priority")


@query("""WITH s AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 11 = 0), e AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 13 <> 0)
  SELECT coalesce(e.k, n.k) AS o_orderkey, coalesce(n.n, 0) AS shards, CASE WHEN e.k IS NULL THEN 'unexpected' WHEN n.k IS NULL THEN 'missing' WHEN n.n > 1 THEN 'repeated' ELSE 'ok' END AS status
  FROM e FULL JOIN (SELECT k, count(*) AS n FROM s GROUP BY 1) n ON e.k = n.k""")
def shard_merge_coverage(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey")
    shards = o.where("o_orderkey % 7 <> 0").unionByName(o.where("o_orderkey % 11 = 0"))
    return benchmark.merge_shards(shards, o.where("o_orderkey % 13 <> 0"), ["o_orderkey"])


@query("""WITH e AS (SELECT recording_id, frame, sqrt((x * 1.01 - x) ** 2 + (y + 0.1 - y) ** 2) AS e FROM @poses), s AS (SELECT recording_id, list_sort(list(e)) AS s, arg_max(e, frame) AS t FROM e GROUP BY 1)
  SELECT recording_id, round(s[floor(0.5 * (len(s) - 1) + 0.5)::INT + 1], 6) AS median_error, round(s[floor(0.9 * (len(s) - 1) + 0.5)::INT + 1], 6) AS p90_error, round(s[len(s)], 6) AS max_error, round(t, 6) AS terminal_error FROM s""")
def error_from_trajectory(spark, sf):
    truth = poses(spark, sf)
    found = truth.select("recording_id", "frame", (F.col("x") * 1.01).alias("x"), (F.col("y") + 0.1).alias("y"))
    return benchmark.trajectory_errors(truth, found).select("recording_id", *r6("median_error", "p90_error", "max_error", "terminal_error"))


def _clusters(spark, sf):
    return results(spark, sf).groupBy("kind", "cluster").agg((F.avg("metric") - 1500).alias("v"))


DRAW_SQL = """('0x' || substr(md5({seed} || '|' || {parts}), 1, 8))::BIGINT"""
BOOT_SQL = f"""c AS (SELECT kind, cluster, avg(metric) - 1500 AS v FROM @results GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY cluster) - 1 AS j, count(*) OVER (PARTITION BY kind) AS n FROM c),
  d AS (SELECT kind, round, j, {DRAW_SQL.format(seed="'7'", parts="kind || '|' || round || '|' || j")} % n AS pick FROM n, (SELECT unnest(range(50)) AS round)),
  h AS (SELECT d.kind, d.round, avg(n.v) AS m FROM d JOIN n ON d.kind = n.kind AND d.pick = n.j GROUP BY ALL), b AS (SELECT round, avg(m) AS mean FROM h GROUP BY 1)"""


@query(f"WITH {BOOT_SQL} SELECT round::INT AS round, round(mean, 6) AS mean FROM b")
def stratified_bootstrap(spark, sf):
    return benchmark.bootstrap(_clusters(spark, sf), "kind", "cluster", "v", 50).select("round", *r6("mean"))


@query(f"WITH {BOOT_SQL} SELECT round(quantile_cont(mean, 0.025), 5) AS low, round(quantile_cont(mean, 0.975), 5) AS high FROM b")
def bootstrap_interval(spark, sf):
    return benchmark.interval(benchmark.bootstrap(_clusters(spark, sf), "kind", "cluster", "v", 50)).select(F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query(f"WITH {BOOT_SQL} SELECT round(quantile_cont(mean, 0.025), 5) AS low, round(quantile_cont(mean, 0.975), 5) AS high, round((1 + count(*) FILTER (mean >= 0)) / (count(*) + 1), 6) AS p FROM b")
def paired_bootstrap_test(spark, sf):
    t = benchmark.paired_test(benchmark.bootstrap(_clusters(spark, sf), "kind", "cluster", "v", 50))
    return t.select(F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), *r6("p"))


@query(f"""WITH c AS (SELECT kind, cluster, avg(metric) - 1500 AS v FROM @results GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY cluster) - 1 AS j, count(*) OVER (PARTITION BY kind) AS n FROM c),
  p AS (SELECT kind, n, size, round, i FROM (SELECT DISTINCT kind, n FROM n), (SELECT unnest([2, 5]) AS size), (SELECT unnest(range(40)) AS round), (SELECT unnest(range(5)) AS i) WHERE i < size),
  s AS (SELECT p.size, p.round, avg(n.v) AS m FROM p JOIN n ON p.kind = n.kind AND n.j = {DRAW_SQL.format(seed="'11'", parts="p.kind || '|' || p.size || '|' || p.round || '|' || p.i")} % p.n GROUP BY ALL)
  SELECT size, round(avg((m < 10)::INT), 6) AS power FROM s GROUP BY 1""")
def power_simulation(spark, sf):
    return benchmark.power(_clusters(spark, sf), "kind", "cluster", "v", [2, 5], 40, 10.0).select("size", *r6("power"))


@query("""WITH n AS (SELECT method, count(*) AS attempted, count(*) FILTER (l_discount < 0.08) AS completed FROM @results GROUP BY 1)
  SELECT method, attempted, completed, attempted - completed AS failed, attempted = (SELECT max(attempted) FROM n) AS fair FROM n""")
def fairness_rows(spark, sf):
    return benchmark.fairness(results(spark, sf), "method", F.col("l_discount") < 0.08)


@query("""WITH g AS (SELECT kind, count(*) AS n, avg((metric <= 1800 AND abs(l_discount - 0.05) <= 0.04)::INT) AS share FROM @results GROUP BY 1) SELECT kind, n, round(share, 6) AS share, share >= 0.6 AS passed FROM g""")
def rigid_gate(spark, sf):
    r = results(spark, sf).withColumn("turn", F.col("l_discount") - 0.05)
    return benchmark.rigid_gate(r, "kind", "metric", "turn", 0.6, 1800.0, 0.04).select("kind", "n", *r6("share"), "passed")


@query("""WITH g AS (SELECT kind, method, (metric - metric * (0.5 + l_discount * 7)) / greatest(metric, 1e-12) AS g FROM @results) SELECT kind, method, round(median(g), 6) AS median_gain, round(avg((g < 0)::INT), 6) AS worse FROM g GROUP BY ALL""")
def guide_residual_score(spark, sf):
    r = results(spark, sf).withColumn("after", F.col("metric") * (0.5 + F.col("l_discount") * 7))
    return benchmark.guide_score(r, ["kind", "method"], "metric", "after").select("kind", "method", *r6("median_gain", "worse"))


@query("""SELECT l_orderkey AS run, CASE method WHEN 'O' THEN 'open' ELSE method END AS method, kind AS series, metric AS error FROM @results""")
def standardise_results(spark, sf):
    out = benchmark.standardised(results(spark, sf), {"O": "open"}, {"run": "l_orderkey", "method": "method", "series": "kind", "error": "metric"})
    return out


@query("""WITH f AS (SELECT recording_id, count(*) AS frames, CASE WHEN recording_id % 3 = 0 THEN NULL ELSE count(*) / 4.0::DOUBLE END AS score FROM @poses GROUP BY 1)
  SELECT recording_id, '{"frames":' || frames || ',"score":' || coalesce(CASE WHEN score = floor(score) THEN score::BIGINT || '.0' ELSE rtrim(printf('%.2f', score), '0') END, 'null') || '}' AS json FROM f""")
def action_envelope(spark, sf):
    f = poses(spark, sf).groupBy("recording_id").agg(F.count(F.lit(1)).alias("frames"))
    bad = F.when(F.col("recording_id") % 6 == 0, F.lit(float("nan"))).when(F.col("recording_id") % 3 == 0, F.lit(float("inf")))
    return benchmark.envelope(f.withColumn("score", F.coalesce(bad, F.col("frames") / 4.0)), ["recording_id"], ["frames", "score"])


@query("""SELECT row_number() OVER (ORDER BY kind) + 2 AS line_no, '| ' || kind || ' | ' || n || ' |' AS line FROM (SELECT kind, count(*) AS n FROM @results GROUP BY 1)
  UNION ALL SELECT 1, '| kind | n |' UNION ALL SELECT 2, '| --- | --- |'""")
def markdown_report(spark, sf):
    r = results(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return benchmark.markdown(r, ["kind", "n"], ["kind"]).withColumn("line_no", F.col("line_no").cast("long"))


@query("SELECT l_orderkey, l_linenumber, round(metric, 6) AS metric FROM @results ORDER BY @results_metric DESC, l_orderkey, l_linenumber LIMIT 25".replace("@results_metric", "metric"))
def global_head(spark, sf):
    return results(spark, sf).orderBy(F.desc("metric"), "l_orderkey", "l_linenumber").limit(25).select("l_orderkey", "l_linenumber", *r6("metric"))


@query("""SELECT recording_id, round(sqrt(greatest(0, (regr_syy(x, frame) - coalesce(regr_sxy(x, frame) ** 2 / nullif(regr_sxx(x, frame), 0), 0)
  + regr_syy(y, frame) - coalesce(regr_sxy(y, frame) ** 2 / nullif(regr_sxx(y, frame), 0), 0)) / count(*))), 4) AS residual FROM @poses GROUP BY 1""")
def path_linearity(spark, sf):
    return evidence.linearity(poses(spark, sf)).select("recording_id", F.round("residual", 4).alias("residual"))


@query("""WITH p AS (SELECT recording_id, max(y) AS far, ['PHASE_CONTRAST', 'BRIGHTFIELD_DIC', 'DENSE_FLUORESCENCE', 'SPARSE_LOW_LIGHT_FLUORESCENCE', 'FIDUCIAL_STATIC'][recording_id % 5 + 1] AS image FROM @poses WHERE frame < 4 GROUP BY 1)
  SELECT recording_id, image, CASE image WHEN 'BRIGHTFIELD_DIC' THEN 0.001 WHEN 'DENSE_FLUORESCENCE' THEN 0.002 WHEN 'FIDUCIAL_STATIC' THEN 0.005 WHEN 'SPARSE_LOW_LIGHT_FLUORESCENCE' THEN 0.010
    ELSE CASE WHEN far > 5 THEN 0.005 ELSE 0.010 END END::DOUBLE AS least_gain FROM p""")
def rotation_selector(spark, sf):
    names = F.array(*[F.lit(x) for x in ("PHASE_CONTRAST", "BRIGHTFIELD_DIC", "DENSE_FLUORESCENCE", "SPARSE_LOW_LIGHT_FLUORESCENCE", "FIDUCIAL_STATIC")])
    p = poses(spark, sf).where("frame < 4").groupBy("recording_id").agg(F.max("y").alias("far")).withColumn("image", F.get(names, (F.col("recording_id") % 5).cast("int")))
    return p.select("recording_id", "image", evidence.rotation_gain(F.col("image"), F.col("far") - 3).alias("least_gain"))


@query("""WITH f AS (SELECT recording_id, avg(x) AS fx, avg(y) AS fy, max(x) AS top FROM @poses GROUP BY 1)
  SELECT recording_id, CASE WHEN fx > 260 AND fy > 3 THEN 'MEDIAN_3X3_AND_SPATIAL_MASK_25' WHEN fx > 260 THEN 'SPATIAL_MASK_25' WHEN fy > 3.2 THEN 'MEDIAN_3X3'
    WHEN top > 495 THEN 'GAUSSIAN_0_7' WHEN top > 470 THEN 'GAUSSIAN_1_0' ELSE 'NONE' END AS recipe FROM f""")
def filter_selector(spark, sf):
    scores = {"mask": F.col("fx"), "median_mask": F.col("fy"), "median": F.col("fy"), "gaussian_0_7": F.col("top"), "gaussian_1_0": F.col("top")}
    least = {"mask": 260.0, "median_mask": 3.0, "median": 3.2, "gaussian_0_7": 495.0, "gaussian_1_0": 470.0}
    return _features(spark, sf).select("recording_id", evidence.filter_choice(scores, least).alias("recipe"))


@query("""WITH g AS (SELECT recording_id, avg(x) / 100 AS u, avg(y) AS r, max(x) / 200 AS c FROM @poses GROUP BY 1)
  SELECT recording_id, CASE WHEN greatest(u, r, c) < 2.6 THEN 'EQUAL' WHEN u = greatest(u, r, c) THEN 'UNCERTAINTY' WHEN r = greatest(u, r, c) THEN 'ROBUST' ELSE 'COMBINED' END AS weighting, greatest(u, r, c) < 2.6 AS fallback FROM g""")
def reconciliation_selector(spark, sf):
    f = _features(spark, sf).select("recording_id", (F.col("fx") / 100).alias("uncertainty"), F.col("fy").alias("robust"), (F.col("top") / 200).alias("combined"))
    return evidence.weighting_choice(f, 2.6, fixed_only=False)
