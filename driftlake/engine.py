"""Registration of recordings stored as one row a plane.

planes: (recording_id, frame, [c, z,] height, width, pixels array<float>), NaN or null for missing pixels.

Pairs are fitted in blocks of frames: a plane goes to its own block and to those whose pairs end in it, so that a task
builds each pyramid once and holds a block of frames and the longest lag at most, however long the recording is. Only the
fits, without pixels, are grouped by recording for the reconciliation. Repair and reports are window functions.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.kernels import evidence as ke, filters, fit, longitudinal as lg, masks as kmasks, planes as kp, solve
from driftlake.operators import evidence, repair
from driftlake.functions.stats import upper_median
from driftlake.operators import planning
from driftlake.operators.planning import LAGS, owners

#: Frames of a block: as many as hold about PIXELS pixels, between the two bounds.
BLOCKS, PIXELS = (4, 32), 1 << 21
PAIR = "recording_id {id}, from_frame int, to_frame int, dx double, dy double, theta double, log_gain double, residual_before double, residual_after double, valid_fraction double, iterations int, status string, covariance array<double>"
WEIGHTINGS = ("EQUAL", "UNCERTAINTY", "ROBUST", "COMBINED")
REFERENCES = ("CONSECUTIVE", "MULTILAG", "FIXED")
INTERPOLATIONS = {"NONE": 0, "BILINEAR": 1, "BICUBIC": 2, "FOURIER": 1}


def estimation_planes(planes: DataFrame, channel: int = 1, slice_: int = 0) -> DataFrame:
    """One plane a frame: a channel (from 1), and a slice (from 1) or the largest value over all slices (0)."""
    p = planes
    if "c" in p.columns:
        p = p.where(F.col("c") == channel - 1)
    if "z" in p.columns and slice_:
        p = p.where(F.col("z") == slice_ - 1)
    elif "z" in p.columns:
        first = F.collect_list("pixels")
        most = F.aggregate(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(1))), F.get(first, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(F.nanvl(x, F.lit(None)), F.nanvl(y, F.lit(None)))))
        p = p.groupBy("recording_id", "frame").agg(F.first("height").alias("height"), F.first("width").alias("width"), most.alias("pixels"))
    return p.select("recording_id", "frame", "height", "width", "pixels")


def _array(row, filter_: str) -> np.ndarray:
    a = np.array([np.nan if v is None else v for v in row.pixels] if isinstance(row.pixels, list) else row.pixels, np.float32)
    return filters.apply(a.reshape(row.height, row.width), filter_)


def _size(height: int, width: int) -> int:
    return max(BLOCKS[0], min(BLOCKS[1], PIXELS // (height * width)))


def _blocks(p: DataFrame, reference: str, furthest: int) -> DataFrame:
    """Planes with the blocks that need them: their own, and those whose pairs end in them."""
    size = F.greatest(F.lit(BLOCKS[0]), F.least(F.lit(BLOCKS[1]), F.floor(F.lit(PIXELS) / (F.col("height") * F.col("width"))))).cast("int")
    block = F.floor(F.col("frame") / size).cast("int")
    if reference == "FIXED":
        zero = p.where("frame = 0").drop("frame").withColumn("frame", F.lit(0))
        blocks = p.where("frame > 0").select("recording_id", block.alias("block")).distinct()
        return p.where("frame > 0").withColumn("block", block).unionByName(zero.join(blocks, "recording_id"))
    before = F.floor((F.col("frame") - furthest) / size).cast("int")
    return p.withColumn("block", F.explode(F.sequence(F.greatest(before, F.lit(0)), block)))


def _dealt(p: DataFrame):
    """Blocks in many tasks: their work goes by pairs, not by bytes, so adaptive execution must not put them together."""
    n = 4 * int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return p.repartition(n, "recording_id", "block").groupBy("recording_id", "block")


def _pairs_of(frames: list[int], block: int, size: int, reference: str, lags: tuple[int, ...]) -> list[tuple[int, int]]:
    there, lo = set(frames), block * size
    if reference == "FIXED":
        return [(0, t) for t in frames if t]
    return [(t, t + k) for t in frames if lo <= t < lo + size for k in lags if t + k in there]


def fit_pairs(planes: DataFrame, options: fit.Options = fit.Options(), reference: str = "MULTILAG", lags: tuple[int, ...] = LAGS, filter_: str = "NONE", starts: DataFrame | None = None, masks: DataFrame | None = None, coarse: bool = False, angles: DataFrame | None = None) -> DataFrame:
    """Fits of all planned pairs.

    starts (recording_id, frame, x, y, theta): poses to refine from instead of a search; a pair that is refused so is
    fitted again from a search. masks (recording_id, mask): pixels of the reference that count, brought to each frame by
    its start. angles (recording_id, frame, angle): turns that are known and held. coarse: only the smallest level of a deep pyramid, with a bound of half its side; moves at full size.
    """
    if reference not in REFERENCES:
        raise ValueError(f"unknown reference {reference}")
    if reference == "MULTILAG" and 1 not in lags:
        raise ValueError("a multi-lag plan needs lag 1")
    if masks is not None and starts is None:
        raise ValueError("masks need starts")
    own = (1,) if reference == "CONSECUTIVE" else lags
    names = [c.split()[0] for c in PAIR.split(", ")]
    started, masked, turned = starts is not None, masks is not None, angles is not None
    kind = planes.schema["recording_id"].dataType.simpleString()
    p = planes.select("recording_id", "frame", "height", "width", "pixels")
    if starts is not None:
        p = p.join(starts.select("recording_id", "frame", "x", "y", "theta"), ["recording_id", "frame"], "left")
    if turned:
        p = p.join(angles.select("recording_id", "frame", "angle"), ["recording_id", "frame"], "left")
    if masks is not None:
        p = p.join(masks.select("recording_id", "mask"), "recording_id", "left")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        rows = list(pdf.itertuples())
        place = {r.frame: i for i, r in enumerate(rows)}
        pairs = _pairs_of(list(place), key[1], _size(rows[0].height, rows[0].width), reference, own)
        if not pairs:
            return pd.DataFrame(columns=names)
        arrays, start, support = [_array(r, filter_) for r in rows], None, None
        if started:
            poses = np.array([(r.x, r.y, r.theta) for r in rows], float)
            start = np.array([solve.then(solve.inverse(poses[place[a]]), poses[place[b]]) for a, b in pairs])
        if coarse:
            stacks, at, grow = *fit.coarse_stack(arrays, options), 1
            stacks, at, grow = [stacks[-1]], at, 1 << (len(stacks) - 1)
        elif options.estimator in fit.STACKED:
            stacks, at, grow = fit.prepare_stack(arrays, options), options, 1
        else:
            stacks = None
        if stacks is not None:
            if masked and isinstance(rows[0].mask, bytes):
                m = np.unpackbits(np.frombuffer(rows[0].mask, np.uint8))[: arrays[0].size].reshape(arrays[0].shape).astype(bool)
                each = [kmasks.projected(m, len(stacks), q if np.isfinite(q).all() else np.zeros(3)) for q in poses]
                support = [np.stack([x[level] for x in each]) for level in range(len(stacks))]
            ia, ib = (np.array([place[q[k]] for q in pairs]) for k in (0, 1))
            theta = np.nan_to_num([rows[j].angle - rows[i].angle for i, j in zip(ia, ib, strict=True)]) if turned else None
            fits = fit.log_ratio_rows(stacks, ia, stacks, ib, at, start, theta, support)
            again = [k for k, f in enumerate(fits) if started and not f.usable]
            if again:
                for k, f in zip(again, fit.log_ratio_rows(stacks, ia[again], stacks, ib[again], at, None, None if theta is None else theta[again], support), strict=True):
                    fits[k] = f
        else:
            pyramids = [fit.prepare(a, options) for a in arrays]
            fits = [fit.ESTIMATORS[options.estimator](pyramids[place[a]], pyramids[place[b]], options) for a, b in pairs]
            grow = 1
        cov = lambda c: None if c is None else c.ravel().tolist()
        out = [(key[0], a, b, f.dx * grow, f.dy * grow, f.theta, f.log_gain, f.residual_before, f.residual_after, f.valid_fraction, f.iterations, f.status, cov(f.covariance)) for (a, b), f in zip(pairs, fits, strict=True)]
        return pd.DataFrame(out, columns=names)

    return _dealt(_blocks(p, reference, max(own))).applyInPandas(run, PAIR.replace("{id}", kind))


EVENT = "recording_id {id}, event_frame int, delta double, pairs int, usable int, inliers int, spread double, status string"


def event_rotations(planes: DataFrame, events: DataFrame, options: fit.Options = fit.Options(), window: int = 3, filter_: str = "NONE") -> DataFrame:
    """(EVENT) turns at known events (recording_id, event_frame): rigid fits of all frames within `window` before an event
    with those behind it; near pairs with much overlap weigh more. Each event is a task of its own."""
    if window < 1:
        raise ValueError("the window has a frame at least")
    kind, o = planes.schema["recording_id"].dataType.simpleString(), replace(options, rotation=True, estimator="LOG_RATIO_FIT")
    near = events.select("recording_id", "event_frame", F.explode(F.sequence(F.col("event_frame") - window, F.col("event_frame") + (window - 1))).alias("frame"))
    p = planes.select("recording_id", "frame", "height", "width", "pixels").join(near, ["recording_id", "frame"])

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("frame").itertuples())
        before, after = ([i for i, r in enumerate(rows) if (r.frame < key[1]) == side] for side in (True, False))
        pairs, good = [(i, j) for i in before for j in after], []
        if pairs:
            stacks = fit.prepare_stack([_array(r, filter_) for r in rows], o)
            fits = fit.log_ratio_rows(stacks, np.array([q[0] for q in pairs]), stacks, np.array([q[1] for q in pairs]), o)
            good = [(f, rows[j].frame - rows[i].frame) for f, (i, j) in zip(fits, pairs, strict=True) if f.usable and "ROTATION_BOUND" not in f.status]
        got = solve.event_turn([f.theta for f, _ in good], [max(1e-6, f.valid_fraction) / (gap + 1) for f, gap in good], o.max_rotation)
        return pd.DataFrame([(key[0], int(key[1]), got["delta"], len(pairs), len(good), got["inliers"], got["spread"], got["status"])], columns=[c.split()[0] for c in EVENT.split(", ")])

    return p.groupBy("recording_id", "event_frame").applyInPandas(run, EVENT.replace("{id}", kind))


def event_angles(frames: DataFrame, turns: DataFrame) -> DataFrame:
    """(recording_id, frame, angle): the sum of the turns of all events up to a frame; events without a turn add none."""
    from pyspark.sql import Window

    steps = turns.select("recording_id", F.col("event_frame").alias("frame"), F.nanvl("delta", F.lit(0.0)).alias("turn"))
    j = frames.select("recording_id", "frame").join(steps, ["recording_id", "frame"], "left")
    so_far = Window.partitionBy("recording_id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return j.select("recording_id", "frame", F.sum(F.coalesce("turn", F.lit(0.0))).over(so_far).alias("angle"))


def shift_bound(planes: DataFrame, options: fit.Options = fit.Options(), reference: str = "MULTILAG", lags: tuple[int, ...] = LAGS, filter_: str = "NONE") -> DataFrame:
    """(recording_id, largest, suggested, resolution, pairs): the largest move that a coarse pass measures, and a bound for it."""
    pairs = fit_pairs(planes, options, reference, lags, filter_, coarse=True).where("status <> 'REFUSED_LOW_OVERLAP'")
    moves = pairs.groupBy("recording_id").agg(F.max(F.hypot("dx", "dy")).alias("largest"), F.count(F.lit(1)).alias("pairs"))
    least = F.least("height", "width")
    # halvings down to 32 pixels, eight at most
    depth = F.greatest(F.lit(0), F.least(F.lit(8), F.floor(F.log2(least / 32)).cast("int")))
    size = planes.groupBy("recording_id").agg(F.max(depth).alias("depth"))
    grow = F.pow(F.lit(2.0), F.col("depth"))
    largest = F.coalesce("largest", F.lit(0.0))
    return size.join(moves, "recording_id", "left").select("recording_id", largest.alias("largest"), F.greatest(F.lit(30.0), 1.5 * largest + grow).alias("suggested"), grow.alias("resolution"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def temporal_scores(planes: DataFrame, poses: DataFrame, lags: tuple[int, ...] = LAGS, epsilon: float = 1.0) -> DataFrame:
    """(recording_id, height, width, instability, growth): how unsteady each pixel is over the lags, in the coordinates of
    frame 0. Blocks of frames give sums, which are added up for each recording: no row holds a pixel."""
    kind = planes.schema["recording_id"].dataType.simpleString()
    p = planes.select("recording_id", "frame", "height", "width", "pixels").join(poses.select("recording_id", "frame", "x", "y", "theta"), ["recording_id", "frame"])

    def sums(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {r.frame: r for r in pdf.itertuples()}
        made = {t: kp.log_plane(_array(r, "NONE"), epsilon) for t, r in rows.items()}
        where = {t: np.array([r.x, r.y, r.theta]) for t, r in rows.items()}
        first, out = next(iter(rows.values())), []
        for k in lags:
            total, n = kmasks.lag_sums(made, where, _pairs_of(sorted(rows), key[1], _size(first.height, first.width), "MULTILAG", (k,)))
            out.append((key[0], k, first.height, first.width, total.tobytes(), n.tobytes()))
        return pd.DataFrame(out, columns=["recording_id", "lag", "height", "width", "total", "n"])

    parts = _dealt(_blocks(p, "MULTILAG", max(lags))).applyInPandas(sums, f"recording_id {kind}, lag int, height int, width int, total binary, n binary")

    def scores(key, pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])
        total, n = np.zeros((len(lags), h * w)), np.zeros((len(lags), h * w))
        for r in pdf.itertuples():
            total[lags.index(r.lag)] += np.frombuffer(r.total)
            n[lags.index(r.lag)] += np.frombuffer(r.n, np.int64)
        found = kmasks.temporal(np.divide(total, n, out=np.full(total.shape, np.nan), where=n > 0), lags, h, w)
        return pd.DataFrame({"recording_id": [key[0]], "height": [h], "width": [w], "instability": [found[0].ravel()], "growth": [found[1].ravel()]})

    return parts.groupBy("recording_id").applyInPandas(scores, f"recording_id {kind}, height int, width int, instability array<double>, growth array<double>")


def pixel_masks(planes: DataFrame, strategy: str, percent: float, poses: DataFrame | None = None, lags: tuple[int, ...] = LAGS, epsilon: float = 1.0) -> DataFrame:
    """(recording_id, mask): packed bits of the pixels of frame 0 that stay; `poses` are needed for temporal strategies."""
    if strategy not in kmasks.STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    kind = planes.schema["recording_id"].dataType.simpleString()
    zero = planes.where("frame = 0").select("recording_id", "height", "width", "pixels")
    timed = kmasks.STRATEGIES[strategy][0] != "information"
    if timed:
        if poses is None:
            raise ValueError(f"{strategy} needs poses")
        zero = zero.join(temporal_scores(planes, poses, lags, epsilon).select("recording_id", "instability", "growth"), "recording_id")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a = _array(r, "NONE")
                more = [np.asarray(getattr(r, c), float).reshape(a.shape) for c in ("instability", "growth")] if timed else []
                out.append(np.packbits(kmasks.mask(a, strategy, percent, epsilon, *more).ravel()).tobytes())
            yield pd.DataFrame({"recording_id": pdf["recording_id"], "mask": out})

    return zero.mapInPandas(run, f"recording_id {kind}, mask binary")


def rolling(planes: DataFrame, options: fit.Options = fit.Options(), window: int = 5, filter_: str = "NONE") -> DataFrame:
    """(recording_id, frame, x, y, theta, support) against a template that follows: the mean of the last `window` frames,
    moved back and freed of their gain. A recording is streamed in order; a task holds `window` planes."""
    kind = planes.schema["recording_id"].dataType.simpleString()
    src = planes.select("recording_id", "frame", "height", "width", "pixels").repartition("recording_id").sortWithinPartitions("recording_id", "frame")

    def run(batches):
        now, recent = object(), []
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                if r.recording_id != now:
                    now, recent, pose = r.recording_id, [], np.zeros(3)
                a = _array(r, filter_)
                support, gain = 1, 0.0
                if recent:
                    f = fit.log_ratio(fit.prepare(np.exp2(np.nanmean(recent, axis=0)) - options.epsilon, options), fit.prepare(a, options), options)
                    support, gain = int(f.usable), f.log_gain if f.usable else 0.0
                    pose = np.array([f.dx, f.dy, f.theta]) if f.usable else pose
                out.append((r.recording_id, r.frame, *map(float, pose), support))
                if support:
                    level = np.log2(np.maximum(a + options.epsilon, 1e-6)) - gain
                    recent = [*recent, kp.warp(level.astype(np.float64), pose, "BILINEAR", np.nan)][-window:]
            yield pd.DataFrame(out, columns=["recording_id", "frame", "x", "y", "theta", "support"])

    return src.mapInPandas(run, f"recording_id {kind}, frame int, x double, y double, theta double, support int")


def reconcile(pairs: DataFrame, frames: DataFrame, reference: str = "MULTILAG", weighting: str = "EQUAL") -> DataFrame:
    """(recording_id, frame, x, y, theta, support): one pose a frame, relative to frame 0."""
    if weighting not in WEIGHTINGS:
        raise ValueError(f"unknown weighting {weighting}")
    kind = frames.schema["recording_id"].dataType.simpleString()
    size = [F.max(F.col(c)).alias(c) if c in frames.columns else F.lit(1).alias(c) for c in ("height", "width")]
    n = frames.groupBy("recording_id").agg((F.max("frame") + 1).cast("int").alias("n"), *size)
    edges = n.join(pairs, "recording_id", "left")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        ok = pdf[pdf["status"].notna() & (pdf["status"] != "REFUSED_LOW_OVERLAP")].sort_values(["from_frame", "to_frame"])
        e = list(zip(ok["from_frame"].astype(int), ok["to_frame"].astype(int), ok["dx"], ok["dy"], ok["theta"], strict=True))
        if reference == "FIXED":
            poses, support = solve.fixed(n, e)
        elif reference == "CONSECUTIVE":
            poses, support = solve.chain(n, e)
        else:
            cov = None
            if weighting in ("UNCERTAINTY", "COMBINED"):
                cov = [None if c is None else np.reshape(c, (2, 2) if len(c) == 4 else (3, 3)) for c in ok["covariance"]]
            turns = bool((ok["theta"] != 0).any())
            got = solve.reconciled(n, e, weighting, fit.rms_radius(int(pdf["height"].iloc[0]), int(pdf["width"].iloc[0])), cov, turns)
            poses, support = got["poses"], got["support"]
        return pd.DataFrame({"recording_id": key[0], "frame": np.arange(n), "x": poses[:, 0], "y": poses[:, 1], "theta": poses[:, 2], "support": support})

    got = edges.groupBy("recording_id").applyInPandas(run, f"recording_id {kind}, frame int, x double, y double, theta double, support int")
    return got.join(frames.select("recording_id", F.col("frame").cast("int").alias("frame")), ["recording_id", "frame"], "left_semi")


def repaired(poses: DataFrame, outlier_mads: float = 6.0, protected: DataFrame | None = None) -> DataFrame:
    """Poses with unsupported frames and outlier steps filled from their trusted neighbours; steps to `protected` frames
    (recording_id, frame) are no outliers."""
    p = repair.outliers(poses, outlier_mads) if outlier_mads else poses.withColumn("outlier", F.lit(False))
    if protected is not None:
        p = p.join(protected.select("recording_id", "frame", F.lit(True).alias("_safe")).distinct(), ["recording_id", "frame"], "left")
        p = p.withColumn("outlier", F.col("outlier") & F.col("_safe").isNull()).drop("_safe")
    p = p.withColumn("trusted", (F.col("frame") == 0) | ((F.col("support") > 0) & ~F.col("outlier")))
    why = F.when(F.col("trusted"), F.lit(None)).when(F.col("support") > 0, "OUTLIER_STEP").otherwise("UNSUPPORTED")
    f = repair.fill(p).withColumn("repair", why)
    return f.select("recording_id", "frame", F.col("x_filled").alias("dx"), F.col("y_filled").alias("dy"), "theta", "support", "repair")


def estimate(planes: DataFrame, options: fit.Options = fit.Options(), reference: str = "MULTILAG", lags: tuple[int, ...] = LAGS, filter_: str = "NONE", weighting: str = "EQUAL", outlier_mads: float = 6.0, channel: int = 1, slice_: int = 0, mask: str | None = None, mask_percent: float = 25.0, warm: bool = False, events: DataFrame | None = None, event_window: int = 3) -> tuple[DataFrame, DataFrame]:
    """(trajectory, pairs) of all recordings.

    mask: a strategy by which pixels are left out of a second pass, which starts from the first one's poses. warm: longer
    lags start from the poses that lag 1 gives. events (recording_id, event_frame): frames where recordings are known to
    turn; the turns are measured first, then held, and steps to these frames are kept.
    """
    frames = planes.select("recording_id", "frame", "height", "width").distinct()
    if weighting in ("UNCERTAINTY", "COMBINED"):
        options = replace(options, uncertainty=True)
    p = estimation_planes(planes, channel, slice_)
    angles = safe = None
    if events is not None:
        angles = event_angles(frames, event_rotations(p, events, options, event_window, filter_))
        safe = events.select("recording_id", F.col("event_frame").alias("frame"))
        options = replace(options, rotation=False)
    if warm and reference == "MULTILAG":
        first = fit_pairs(p, options, "CONSECUTIVE", filter_=filter_)
        pairs = fit_pairs(p, options, reference, lags, filter_, _as_starts(repaired(reconcile(first, frames, "CONSECUTIVE"), outlier_mads)))
    else:
        pairs = fit_pairs(p, options, reference, lags, filter_, angles=angles)
    if mask is not None and mask_percent > 0:
        starts = _as_starts(repaired(reconcile(pairs, frames, reference, weighting), outlier_mads, safe))
        pairs = fit_pairs(p, options, reference, lags, filter_, starts, pixel_masks(p, mask, mask_percent, starts, lags, options.epsilon), angles=angles)
    return repaired(reconcile(pairs, frames, reference, weighting), outlier_mads, safe), pairs


def _as_starts(trajectory: DataFrame) -> DataFrame:
    return trajectory.select("recording_id", "frame", F.col("dx").alias("x"), F.col("dy").alias("y"), "theta")


def apply_transforms(planes: DataFrame, trajectory: DataFrame, interpolation: str = "BILINEAR", crop: bool = True) -> DataFrame:
    """Every plane (all channels and slices) warped by its frame's pose, cut to what all frames of a recording cover."""
    if interpolation not in INTERPOLATIONS:
        raise ValueError(f"unknown interpolation {interpolation}")
    reach = INTERPOLATIONS[interpolation]
    side = F.ceil(F.max(F.greatest(F.abs("dx"), F.abs("dy")) + F.ceil(F.abs("theta") * 1.0))).cast("int")
    pad = trajectory.groupBy("recording_id").agg(F.max(F.abs("theta")).alias("turn"), side.alias("side"))
    t = trajectory.select("recording_id", "frame", "dx", "dy", "theta").join(pad, "recording_id")
    both = planes.join(t, ["recording_id", "frame"])
    cols = planes.columns

    def run(batches):
        for pdf in batches:
            out = pdf[cols].copy()
            pixels, heights, widths = [], [], []
            for r in pdf.itertuples():
                a = np.asarray(r.pixels, np.float32).reshape(r.height, r.width)
                w = kp.warp(a, (r.dx, r.dy, r.theta), interpolation)
                m = min(int(r.side) + reach + int(np.ceil(r.turn * np.hypot(r.height, r.width) / 2)), min(a.shape) // 2 - 1) if crop else 0
                w = w[m : r.height - m, m : r.width - m]
                pixels.append(w.ravel())
                heights.append(w.shape[0])
                widths.append(w.shape[1])
            out["pixels"], out["height"], out["width"] = pixels, heights, widths
            yield out

    return both.mapInPandas(run, planes.schema)


def register(planes: DataFrame, interpolation: str = "BILINEAR", crop: bool = True, **options) -> tuple[DataFrame, DataFrame]:
    """(corrected planes, trajectory)."""
    trajectory, _ = estimate(planes, **options)
    return apply_transforms(planes, trajectory, interpolation, crop), trajectory


def report(trajectory: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a recording: frames, repairs, largest move, counts of its pairs, and the medians of the residuals of the
    pairs that own its frames (the shortest that ends there)."""
    t = trajectory.groupBy("recording_id").agg(F.count(F.lit(1)).alias("frames"), F.count("repair").alias("repaired"), F.max(F.hypot("dx", "dy")).alias("largest_move"))
    p = pairs.groupBy("recording_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("status") == "REFUSED_LOW_OVERLAP").alias("refused"), F.count_if(F.col("status") == "NOT_CONVERGED").alias("not_converged"),
        F.count_if(F.col("status").like("AT%")).alias("at_bound"),
    )
    plan = pairs.withColumn("lag", F.abs(F.col("to_frame") - F.col("from_frame"))).withColumn("plan_index", F.col("from_frame"))
    own = owners(plan).join(plan.select("recording_id", F.col("to_frame").alias("frame"), "from_frame", "residual_before", "residual_after"), ["recording_id", "frame", "from_frame"])
    finite = lambda c: F.collect_list(F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)))
    r = own.groupBy("recording_id").agg(*[upper_median(finite(c)).alias(c) for c in ("residual_before", "residual_after")])
    return t.join(p, "recording_id", "left").join(r, "recording_id", "left")


def localisability(planes: DataFrame) -> DataFrame:
    """Mean over consecutive frames of the correlation at rest less that of a one-pixel shift; and the rank of each channel."""
    p = planes.select("recording_id", "c", "frame", "height", "width", "pixels")
    q = p.select("recording_id", "c", (F.col("frame") - 1).alias("frame"), F.col("pixels").alias("next"))

    @F.pandas_udf("double")
    def gap(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for x, y, n, m in zip(a, b, h, w, strict=True):
            x, y = np.asarray(x, float).reshape(n, m), np.asarray(y, float).reshape(n, m)
            right, down = np.pad(y, ((0, 0), (0, 1)), "edge")[:, 1:], np.pad(y, ((0, 1), (0, 0)), "edge")[1:]
            c = lambda u, v: np.corrcoef(u.ravel(), v.ravel())[0, 1]
            out.append(c(x, y) - 0.5 * (c(x, right) + c(x, down)))
        return pd.Series(out)

    from pyspark.sql import Window

    s = p.join(q, ["recording_id", "c", "frame"]).groupBy("recording_id", "c").agg(F.avg(gap("pixels", "next", "height", "width")).alias("localisability"))
    rank = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.nanvl("localisability", F.lit(None)).desc_nulls_last(), "c"))
    return s.withColumn("rank", rank).withColumn("poor", F.coalesce(F.col("localisability") < 0.05, F.lit(True)))


def evidence_features(planes: DataFrame, epsilon: float = 1.0) -> DataFrame:
    """(recording_id, reason, features): what recordings look like, from their first two, middle and last frames alone.

    The image features are the medians over the three frames; a recording that gives no evidence has a reason.
    """
    kind = planes.schema["recording_id"].dataType.simpleString()
    n = planes.groupBy("recording_id").agg((F.max("frame") + 1).alias("n"))
    half = F.floor(F.col("n") / 2)
    some = planes.join(n, "recording_id").where((F.col("frame") <= 1) | (F.col("frame") == half) | (F.col("frame") == F.col("n") - 1))
    names = (*ke.IMAGE, *ke.PAIR, *ke.ADMITTED)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        at = {r.frame: _array(r, "NONE") for r in pdf.itertuples()}
        n, first = int(pdf["n"].iloc[0]), at[min(at)]
        three = [at[t] for t in (0, n // 2, n - 1) if t in at]
        values = np.concatenate([a[np.isfinite(a)] for a in three])
        reason, got = "", np.full(len(names), np.nan)
        if n < 2:
            reason = "fewer than two guide frames"
        elif min(first.shape) < 16:
            reason = "guide plane smaller than 16x16"
        elif not len(values) or not values.max() > values.min():
            reason = "no finite positive raw-image dynamic range"
        else:
            got = np.concatenate((np.nanmedian([ke.image(a) for a in three], axis=0), ke.pair(at[0], at[1], epsilon), ke.admitted(at[0], epsilon)))
        return pd.DataFrame([(key[0], reason, *map(float, got))], columns=["recording_id", "reason", *names])

    return some.groupBy("recording_id").applyInPandas(run, f"recording_id {kind}, reason string, " + ", ".join(f"{x} double" for x in names))


def longitudinal(planes: DataFrame, trajectory: DataFrame, most_degrees: float = 10.0) -> DataFrame:
    """(recording_id, frame, dx, dy, theta, confidence, jump, changed): a trajectory freed of what changing light does to it.

    The lightest and the darkest frame with structure are references; a frame's confidence is how well it agrees, at its
    pose, with the better one. Where consecutive frames hardly agree, rigid bridges are looked for between the frames and
    between the medians around them: each boundary is a task of its own. Only poses and scores are grouped by recording.
    """
    kind = planes.schema["recording_id"].dataType.simpleString()
    p = planes.select("recording_id", "frame", "height", "width", "pixels")

    def features(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                a = _array(r, "NONE")
                h, w = a.shape
                mid = a[round(0.12 * h) : round(0.88 * h), round(0.12 * w) : round(0.88 * w)]
                lo, light, hi = np.nanpercentile(mid, (5, 75, 95))
                rows.append((r.recording_id, r.frame, float(light), float(hi - lo), lg.landmark_feature(a).ravel()))
            yield pd.DataFrame(rows, columns=["recording_id", "frame", "light", "structure", "feature"])

    made = p.mapInPandas(features, f"recording_id {kind}, frame int, light double, structure double, feature array<float>")
    ends = evidence.reference_frames(made.select("recording_id", "frame", "light", "structure"))
    both = made.join(ends, "recording_id")
    refs = both.where((F.col("frame") == F.col("bright")) | (F.col("frame") == F.col("dim"))).groupBy("recording_id").agg(F.collect_list(F.struct("frame", "feature")).alias("refs"))  # two planes at most
    before = made.select("recording_id", (F.col("frame") + 1).alias("frame"), F.col("feature").alias("last"))
    size = p.select("recording_id", "frame", "height", "width")
    poses = trajectory.select("recording_id", "frame", "dx", "dy", "theta")
    joined = made.join(size, ["recording_id", "frame"]).join(poses, ["recording_id", "frame"]).join(before, ["recording_id", "frame"], "left").join(refs, "recording_id")
    at_ref = trajectory.groupBy("recording_id").agg(F.collect_list(F.struct("frame", "dx", "dy", "theta")).alias("all"))
    joined = joined.join(ends, "recording_id").join(at_ref, "recording_id")
    near = F.transform(F.filter("all", lambda q: (q["frame"] == F.col("bright")) | (q["frame"] == F.col("dim"))), lambda q: q)
    joined = joined.withColumn("at", near).drop("all", "light", "structure")

    def scores(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                shape = (r.height, r.width)
                f = np.asarray(r.feature, float).reshape(shape)
                where = {int(q["frame"]): np.array([q["dx"], q["dy"], q["theta"]]) for q in r.at}
                own, found = np.array([r.dx, r.dy, r.theta]), []
                for q in r.refs:
                    pose = solve.then(solve.inverse(where[int(q["frame"])]), own)
                    found.append(lg.correlation(np.asarray(q["feature"], float).reshape(shape), f, pose))
                response = None
                if r.last is not None:
                    response = lg.phase_translation(lg.thumbnail(np.asarray(r.last).reshape(shape), 128), lg.thumbnail(f, 128))[2]
                rows.append((r.recording_id, r.frame, r.height, r.width, *own, float(np.nan_to_num(np.nanmax([0.0, *found]))), response))
            yield pd.DataFrame(rows, columns=["recording_id", "frame", "height", "width", "dx", "dy", "theta", "score", "response"])

    scored = joined.mapInPandas(scores, f"recording_id {kind}, frame int, height int, width int, dx double, dy double, theta double, score double, response double")
    weak = evidence.weak_boundaries(scored.where("response IS NOT NULL").select("recording_id", "frame", "response"))
    around = weak.select("recording_id", F.col("frame").alias("boundary"), F.explode(F.sequence(F.col("frame") - 8, F.col("frame") + 7)).alias("frame"))

    def bridges(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        t = int((pdf["frame"] < key[1]).sum())
        events = lg.rigid_bridges(np.stack([_array(r, "NONE") for r in pdf.itertuples()]), [t], most_degrees) if 0 < t < len(pdf) else []
        return pd.DataFrame([(key[0], int(key[1]), *map(float, e)) for _, e in events], columns=["recording_id", "boundary", "ex", "ey", "et"])

    found = p.join(around, ["recording_id", "frame"]).groupBy("recording_id", "boundary").applyInPandas(bridges, f"recording_id {kind}, boundary int, ex double, ey double, et double")
    sure = evidence.confidence(scored).join(found.withColumnRenamed("boundary", "frame"), ["recording_id", "frame"], "left")

    def mend(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        diagonal = float(np.hypot(pdf["height"].iloc[0], pdf["width"].iloc[0]))
        poses = pdf[["dx", "dy", "theta"]].to_numpy(float)
        events = [(i, e) for i, e in enumerate(pdf[["ex", "ey", "et"]].to_numpy(float)) if i and np.isfinite(e).all()]
        poses = lg.with_events(poses, events)
        path, jumps, changed = lg.repaired(poses * [1, 1, diagonal / 2], pdf["confidence"].to_numpy(float), diagonal)
        out = path / [1, 1, diagonal / 2]
        jump = np.isin(np.arange(len(pdf)), jumps)
        return pd.DataFrame({"recording_id": key[0], "frame": pdf["frame"].to_numpy(), "dx": out[:, 0], "dy": out[:, 1], "theta": out[:, 2], "confidence": pdf["confidence"].to_numpy(float), "jump": jump, "changed": changed})

    return sure.groupBy("recording_id").applyInPandas(mend, f"recording_id {kind}, frame int, dx double, dy double, theta double, confidence double, jump boolean, changed boolean")


def sweep(planes: DataFrame, axes: dict[str, list], options: fit.Options = fit.Options(), **more) -> DataFrame:
    """A row for each recording and setting of up to three axes of Options: its residuals after registration, and the best
    setting of the recording (the least residual, the first on ties)."""
    from pyspark.sql import Window

    out = None
    for i, row in enumerate(planning.sweep_grid(planes.sparkSession, axes).collect()):  # 24 settings at most
        setting = row.asDict()
        rep = report(*estimate(planes, replace(options, **setting), **more)).select("recording_id", "residual_before", "residual_after", "refused")
        rep = rep.withColumns({"setting": F.lit(i), **{k: F.lit(v) for k, v in setting.items()}})
        out = rep if out is None else out.unionByName(rep)
    rank = F.row_number().over(Window.partitionBy("recording_id").orderBy(F.col("residual_after").asc_nulls_last(), "setting"))
    return out.withColumn("best", rank == 1)
