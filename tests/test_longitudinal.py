"""Area and phase estimators, and the route for long recordings."""

import numpy as np
import pytest

from driftlake.kernels import fit, longitudinal as lg, solve
from tests.test_registration import analytic


@pytest.mark.parametrize(("name", "tol"), [("AREA_CORRELATION_LINEAR", 0.05), ("AREA_CORRELATION_SUBSAMPLED", 0.1), ("CROSS_CORRELATION", 0.6)])
def test_more_estimators(name, tol):
    o = fit.Options(estimator=name, max_shift=8)
    a, b = fit.prepare(analytic(), o), fit.prepare(analytic(2.3, -1.6), o)
    f = fit.ESTIMATORS[name](a, b, o)
    assert f.usable and np.hypot(f.dx - 2.3, f.dy + 1.6) < tol


def test_rigid_area_and_its_uncertainty():
    o = fit.Options(max_shift=4, max_rotation=np.radians(3))
    a, b = fit.prepare(analytic(w=64), o), fit.prepare(analytic(1.5, -0.5, 0.03, w=64), o)
    f = fit.rigid_area(a, b, o)
    assert abs(f.theta - 0.03) < 0.005 and np.hypot(f.dx - 1.5, f.dy + 0.5) < 0.1
    cov, ambiguity = fit.area_covariance(a[0], b[0], np.array([f.dx, f.dy, f.theta]), rotation=True)
    assert cov.shape == (3, 3) and np.linalg.eigvalsh(cov).min() > 0 and 0 < ambiguity < 1
    flat = fit.prepare(np.full((64, 64), 5.0, np.float32), o)
    assert fit.area_covariance(flat[0], flat[0], np.zeros(3))[0] is None


def textured(dx=0, dy=0, w=96):
    from driftlake.kernels.filters import gaussian

    big = gaussian(np.random.default_rng(9).random((w + 64, w + 64)), 1.2) * 1000
    return big[32 - dy : 32 - dy + w, 32 - dx : 32 - dx + w].astype(np.float32)


def test_verified_phase_and_multi_scale():
    a, b = textured(), textured(7, -4)
    assert fit.verified_phase(a, b) == (7, -4)
    s = np.zeros((8, 8))
    s[2, 3], s[5, 5], s[0, 0] = 3, 2, 1
    assert fit.strongest_peaks(s, 2) == [(2, 3), (5, 5)]
    assert np.isnan(fit.overlap_correlation(a, b, 95, 0)) and fit.overlap_correlation(a, a, 0, 0) > 0.999
    path = fit.multi_scale_phase(np.stack([textured(2 * t, -t) for t in range(6)]), verify=True)
    assert np.abs(path - np.array([[2.0 * t, -t] for t in range(6)])).max() < 0.6
    steps = np.array([[0, 0]] * 5 + [[6, 0]] * 6, float) + np.random.default_rng(0).normal(size=(11, 2)) * 0.2
    assert len(np.unique(fit.steady_parts(steps), axis=0)) == 2


def test_features_and_bridges():
    rng = np.random.default_rng(3)
    base = rng.random((96, 96))
    from driftlake.kernels.filters import gaussian, normalised

    base = gaussian(base, 2.0) * 5000
    light = np.linspace(1, 3, 96)[:, None]
    e, f = lg.emission_feature(base), lg.emission_feature(base * light)
    assert np.corrcoef(e.ravel(), f.ravel())[0, 1] > 0.8 and 0 <= normalised(base).min() and normalised(base).max() <= 1
    g = lg.landmark_feature(base)
    assert g.shape == base.shape and abs(np.median(g) - lg.LEVEL) < 1
    moved = np.roll(base, (3, -5), (0, 1))
    pose, score = lg.bridge(base, moved, 3.0)
    assert np.hypot(pose[0] + 5, pose[1] - 3) < 1 and score > 0.7
    assert lg.phase_translation(g, lg.landmark_feature(moved))[:2] == (-5.0, 3.0)
    frames = np.stack([base] * 5 + [moved] * 5)
    events = lg.rigid_bridges(frames, [5], 3.0)
    assert [t for t, _ in events] == [5]
    poses = lg.with_events(np.zeros((10, 3)), events)
    assert np.allclose(poses[4], 0) and np.allclose(poses[9], events[0][1])
    ref = lg.landmark_reference(np.stack([g] * 5), np.zeros((5, 3)))
    assert np.isfinite(ref).any() and np.isnan(ref).any()


def test_paths_are_repaired_between_jumps():
    rng = np.random.default_rng(1)
    path = np.zeros((60, 3))
    path[30:, 0] = 40
    path += rng.normal(size=path.shape) * 0.1
    want = path.copy()
    path[10:13, 1] += 15  # comes back
    confidence = np.ones(60)
    confidence[45] = 0
    path[45] = 300
    out, jumps, changed = lg.repaired(path, confidence, 100.0)
    assert jumps == [30] and changed[11] and changed[45] and not changed[20]
    assert np.abs(out - (want - want[0])).max() < 1.0
    assert np.allclose(lg.filled(path, np.zeros(60, bool))[0], np.median(path, axis=0))


def test_the_end_of_a_recording():
    path = np.zeros((50, 3))
    path[49] = [20, 0, 0]
    confidence = np.r_[np.ones(48), 0, 0]
    p, c = lg.protect_end(path, confidence, np.zeros(50), np.full((50, 2), 0.3), np.zeros((50, 3)), 100.0)
    assert c[49] > 0 and c[48] > 0 and np.allclose(p, path)
    p, c = lg.protect_end(path, confidence, np.zeros(50), np.full((50, 2), 0.1), np.zeros((50, 3)), 100.0)
    assert c[49] == 0
    centres = np.tile([40.0, 40.0], (50, 1)) + np.random.default_rng(0).normal(size=(50, 2)) * 0.2
    centres[48:] += [30, 0]
    poses, at = lg.end_repaired(np.zeros((50, 3)), centres, np.full(50, 0.1), 100, 100)
    assert at == 48 and np.hypot(*(poses[-1][:2] - [30, 0])) < 1 and np.allclose(poses[46], 0)
    assert lg.end_repaired(np.zeros((4, 3)), centres[:4], np.ones(4), 9, 9)[1] is None
    a = np.zeros((80, 80))
    a[20:40, 30:60] = 9
    centre, share = lg.bright_part(a + np.random.default_rng(0).random((80, 80)) * 0.1)
    assert np.hypot(*(centre - [44.5, 29.5])) < 1 and abs(share - 600 / 6400) < 0.01


def test_end_chain_needs_the_baseline():
    rng = np.random.default_rng(5)
    from driftlake.kernels.filters import gaussian

    base = gaussian(rng.random((96, 96)), 2.0) * 5000
    frames = np.stack([base] * 12 + [np.roll(base, 8, 1)] * 2)
    baseline = np.zeros((14, 3))
    baseline[12:, 0] = 8
    events = lg.end_chain(frames, baseline, 2.0)
    assert [t for t, _ in events] in ([12, 13], []) and lg.end_chain(frames, np.zeros((14, 3)), 2.0) == []
    if events:
        assert abs(events[0][1][0] - 8) < 1 and np.allclose(solve.inverse(np.zeros(3)), 0)


def _table(spark, frames):
    rows = [("r", t, *a.shape, a.astype(float).ravel().tolist()) for t, a in enumerate(frames)]
    return spark.createDataFrame(rows, "recording_id string, frame int, height int, width int, pixels array<float>")


def test_the_route_for_long_recordings(spark):
    from driftlake import engine

    frames = [textured(0 if t < 12 else 12, 0, 64) * (1 + 0.05 * t) for t in range(24)]
    path = [(0.0 if t < 12 else 12.0) + (9.0 if t == 6 else 0.0) for t in range(24)]
    poses = spark.createDataFrame([("r", t, x, 0.0, 0.0) for t, x in enumerate(path)], "recording_id string, frame int, dx double, dy double, theta double")
    got = engine.longitudinal(_table(spark, frames), poses, 2.0).orderBy("frame").collect()
    assert len(got) == 24 and got[12].jump and sum(r.jump for r in got) == 1
    assert got[6].confidence == 0 and got[6].changed and abs(got[6].dx) < 1 and abs(got[20].dx - 12) < 1


def test_evidence_of_recordings(spark):
    from driftlake import engine
    from driftlake.kernels import evidence as ke

    r = engine.evidence_features(_table(spark, [textured(t, 0, 48) for t in range(5)])).first()
    assert r.reason == "" and all(np.isfinite(r[c]) for c in (*ke.IMAGE, *ke.PAIR, *ke.ADMITTED))
    assert 0 <= r.dark_share <= 1 and r.correlation_x > 0.5 and 0.4 < r.gradient_admitted <= 1
    for frames, why in (([textured()], "two"), ([textured(w=8)] * 3, "16x16"), ([np.full((20, 20), 3.0)] * 3, "range")):
        assert why in engine.evidence_features(_table(spark, frames)).first().reason
    assert np.isnan(ke.image(np.full((4, 4), np.nan))).all()


def test_sweep_and_policies(spark):
    from driftlake import engine
    from driftlake.operators import recipes

    p = _table(spark, [analytic(0.5 * t, 0, w=48) for t in range(4)])
    got = engine.sweep(p, {"norm": ["HUBER", "TUKEY"], "max_shift": [1.0, 6.0]}, lags=(1,)).collect()
    assert len(got) == 4 and sum(r.best for r in got) == 1 and min(got, key=lambda r: (r.residual_after, r.setting)).best
    dense = recipes.emission_policy("DENSE_FLUORESCENCE", "STEADY_DIRECTIONAL_DRIFT")
    assert dense["options"].estimator == "AREA_CORRELATION_ECC" and dense["reference"] == "CONSECUTIVE"
    assert recipes.emission_policy("PHASE_CONTRAST", "STEADY_DIRECTIONAL_DRIFT") is None and recipes.pilot()["mask"] is None


def test_progress_and_cancellation(spark):
    from driftlake import progress

    heard = []
    assert progress.watched(spark, lambda: spark.range(100, numPartitions=4).count(), lambda *n: heard.append(n), 0.01) == 100

    def stop(done, all_):
        raise KeyError("stop")

    slow = lambda: spark.range(4, numPartitions=4).mapInPandas(_sleepy, "id long").count()
    with pytest.raises(KeyError):
        progress.watched(spark, slow, stop, 0.5)


def _sleepy(batches):
    import time

    for b in batches:
        time.sleep(20)
        yield b
