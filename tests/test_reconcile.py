"""The graph solution against plain least squares, and the uncertainty and rotation routes."""

import numpy as np
import pytest

from driftlake.kernels import fit, planes as kp, solve
from tests.test_registration import analytic


def dense(n, edges, info, factors, skip=-1):
    d = info.shape[1]
    normal, y = np.zeros((d * n, d * n)), np.zeros(d * n)
    for k, (a, b, *o) in enumerate(edges):
        if k == skip:
            continue
        j = np.zeros((d, d * n))
        r = np.eye(d)
        r[:2, :2] = [[np.cos(o[2]), -np.sin(o[2])], [np.sin(o[2]), np.cos(o[2])]]
        j[:, d * b : d * b + d], j[:, d * a : d * a + d] = np.eye(d), -r
        w = info[k] * factors[k]
        normal += j.T @ w @ j
        y += j.T @ w @ np.array(o[:d])
    normal = normal[d:, d:] + np.eye(d * (n - 1)) * 1e-9 * np.trace(normal[d:, d:]) / (d * (n - 1))
    return np.concatenate([np.zeros(d), np.linalg.solve(normal, y[d:])]).reshape(n, d)


def noisy(rng, n, lags, d=3):
    truth = np.cumsum(rng.normal(size=(n, 3)) * [1, 1, 0.02 * (d == 3)], axis=0)
    truth -= truth[0]
    edges = []
    for a in range(n):
        for k in lags:
            if a + k < n:
                e = solve.then(solve.inverse(truth[a]), truth[a + k]) + rng.normal(size=3) * [0.1, 0.1, 0.002 * (d == 3)]
                edges.append((a, a + k, *e))
    return truth, edges


@pytest.mark.parametrize(("n", "lags", "d"), [(2, (1,), 2), (7, (1, 2), 3), (40, (1, 2, 4, 8), 3), (33, (1, 5), 2)])
def test_banded_solution_is_the_dense_one(n, lags, d):
    rng = np.random.default_rng(n)
    _, edges = noisy(rng, n, lags, d)
    info = np.array([np.diag(rng.uniform(0.5, 2, d)) for _ in edges])
    factors = rng.uniform(0.1, 1, len(edges))
    g = solve.Graph(n, edges, info)
    g.factorise(factors)
    x = dense(n, edges, info, factors)
    assert np.allclose(g.x, x, atol=1e-6)
    alone, bridge = g.without(factors), solve.bridges(n, [e[:2] for e in edges])
    for k, (a, b, *o) in enumerate(edges):
        y = x if bridge[k] else dense(n, edges, info, factors, k)
        c, s = np.cos(o[2]), np.sin(o[2])
        want = [y[b][0] - c * y[a][0] + s * y[a][1] - o[0], y[b][1] - s * y[a][0] - c * y[a][1] - o[1]] + ([y[b][2] - y[a][2] - o[2]] if d == 3 else [])
        assert np.allclose(alone[k], want, atol=1e-5)


def test_bridges():
    assert solve.bridges(5, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (3, 4)]).tolist() == [False, False, False, True, False, False]


def test_a_wild_edge_loses_its_weight():
    truth, edges = noisy(np.random.default_rng(5), 30, (1, 2, 4))
    edges[10] = (*edges[10][:2], edges[10][2] + 9, *edges[10][3:])
    equal, robust = solve.reconciled(30, edges), solve.reconciled(30, edges, "ROBUST", 20.0)
    err = lambda g: np.abs(g["poses"] - truth).max()
    assert robust["factor"][10] == 0.05 and err(robust) < 0.5 * err(equal)
    assert equal["support"].sum() == 2 * len(edges) + 1 and np.argmax(robust["standardised"]) == 10
    cov = [np.eye(3) * (100.0 if k == 10 else 0.01) for k in range(len(edges))]
    assert err(solve.reconciled(30, edges, "UNCERTAINTY", 20.0, cov)) < 0.5 * err(equal)
    cov[3] = None
    assert solve.reconciled(30, edges, "COMBINED", 20.0, cov)["fallback"].tolist() == [k == 3 for k in range(len(edges))]
    with pytest.raises(ValueError):
        solve.reconciled(30, edges, "OTHER")


def test_pose_changes():
    poses = np.array([[0, 0, 0], [1, 2, 0.1], [3, -1, 0.4]])
    back = solve.rebased(poses, 1)
    assert np.allclose(back[1], 0) and np.allclose(solve.rebased(back, 0), poses)
    assert np.allclose(solve.scaled(poses, 2.0)[2], [6, -2, 0.4]) and np.allclose(solve.known_angles(poses, np.zeros(3))[:, 2], 0)


def test_long_recordings_solve_in_bands():
    truth, edges = noisy(np.random.default_rng(2), 3000, (1, 2, 4, 8, 16), 2)
    got = solve.reconciled(3000, edges, "ROBUST", 30.0, rotation=False)
    assert np.abs(np.diff(got["poses"] - truth, axis=0)).max() < 0.5


def test_uncertainty_shrinks_with_texture_and_is_bounded():
    rng = np.random.default_rng(3)
    o = fit.Options(max_shift=6, uncertainty=True)
    covs = []
    for noise in (5, 80):
        a, b = (fit.prepare(analytic(*m) + rng.normal(size=(96, 96)).astype(np.float32) * noise, o) for m in ((0, 0), (1.5, -0.5)))
        covs.append(fit.log_ratio(a, b, o).covariance)
    assert covs[0].shape == (2, 2) and np.trace(covs[0]) <= np.trace(covs[1])
    for c in covs:
        v = np.linalg.eigvalsh(c)
        assert v.min() >= 0.02**2 * (1 - 1e-9) and v.max() <= 20.0**2
    assert fit.bounded(np.diag([np.nan, 1.0]), 1.0) is None and np.allclose(fit.scaled_covariance(np.eye(2), 2), 4 * np.eye(2))
    back = fit.covariance_of_inverse(fit.covariance_of_inverse(np.diag([1.0, 2.0, 0.1]), (3, 1, 0.2)), solve.inverse((3, 1, 0.2)))
    assert np.allclose(back, np.diag([1.0, 2.0, 0.1]))


def test_rotation_routes():
    o = fit.Options(max_shift=6, max_rotation=np.radians(5))
    a, b, c = (fit.prepare(analytic(*m), o) for m in ((0, 0, 0), (1.5, -0.5, 0.03), (1.5, -0.5, 0)))
    for f in (fit.incremental_rotation(a, b, o, 0.01), fit.gated_rotation(a, b, o, 0.01), fit.split_rotation((a, b, o), (a, b, o), 0.01), fit.fixed_angle(a, b, o, 0.03)):
        assert abs(f.theta - 0.03) < 0.003 and np.hypot(f.dx - 1.5, f.dy + 0.5) < 0.15
    for f in (fit.incremental_rotation(a, c, o, 0.5), fit.gated_rotation(a, c, o, 0.5)):
        assert f.theta == 0 and abs(f.dx - 1.5) < 0.05
    assert np.isnan(fit.rotation_gain(fit.Fit(), fit.Fit()))


def test_mutual_support_is_a_rule_of_its_own():
    rng = np.random.default_rng(1)
    a, b = (analytic(*m) + rng.normal(size=(96, 96)).astype(np.float32) * 30 for m in ((0, 0), (2.3, -1.6)))
    found = {}
    for support in fit.SUPPORTS:
        o = fit.Options(max_shift=8, support=support)
        found[support] = fit.log_ratio(fit.prepare(a, o), fit.prepare(b, o), o)
        assert np.hypot(found[support].dx - 2.3, found[support].dy + 1.6) < 0.1
    assert len({f.dx for f in found.values()}) == 3
    with pytest.raises(ValueError):
        fit.Options(support="OTHER")


def test_stacks_give_what_single_pairs_give():
    o = fit.Options(max_shift=6)
    frames = [analytic(0.7 * t, -0.4 * t) for t in range(5)]
    stacks, one = fit.prepare_stack(frames, o), [fit.prepare(f, o) for f in frames]
    pairs = [(0, 1), (1, 3), (0, 4), (2, 2)]
    many = fit.log_ratio_rows(stacks, np.array([p[0] for p in pairs]), stacks, np.array([p[1] for p in pairs]), o)
    for f, (i, j) in zip(many, pairs, strict=True):
        g = fit.log_ratio(one[i], one[j], o)
        assert (f.status, f.iterations) == (g.status, g.iterations) and np.allclose([f.dx, f.dy, f.residual_after], [g.dx, g.dy, g.residual_after], atol=1e-9)


def test_pyramid_halves_whole_pairs_of_pixels():
    p = kp.log_plane(np.full((7, 9), 3.0, np.float32))
    assert kp.halve(p).value.shape == (3, 4) and np.allclose(kp.halve(p).value, 2.0) and np.allclose(kp.halve(p, linear=True).value, 2.0)
    p.valid[:, :6] = False
    assert not kp.halve(p).valid[:, 0].any() and kp.halve(p).valid[:, 3].all()


def _recording(spark, moves, w=64, noise=0.0):
    rng = np.random.default_rng(0)
    rows = [("r", t, w, w, (analytic(x, y, w=w) + rng.normal(size=(w, w)).astype(np.float32) * noise).ravel().tolist()) for t, (x, y) in enumerate(moves)]
    return spark.createDataFrame(rows, "recording_id string, frame int, height int, width int, pixels array<float>")


def test_information_and_masks():
    from driftlake.kernels import masks

    a = analytic(w=40)
    a[:, :12] = 100.0
    p = kp.log_plane(a)
    info = masks.information(p)
    j, i = 20, 25
    m = sum(np.outer(g, g) for g in [(p.gx[y, x], p.gy[y, x]) for y in range(j - 2, j + 3) for x in range(i - 2, i + 3)]) / 25
    assert np.isclose(info[j, i], np.linalg.eigvalsh(m.astype(float))[0], rtol=1e-4) and info[20, 5] == 0
    keep = masks.eligible(p)
    low = masks.mask(a, "REMOVE_LEAST_INFORMATIVE", 25)
    assert (~low).sum() == int(np.floor(keep.sum() / 4 + 0.5)) and info[~low].max() <= info[low & keep].min()
    steady = np.tile(np.arange(40.0), (40, 1))
    for strategy in masks.STRATEGIES:
        got = masks.mask(a, strategy, 30, 1.0, steady, -steady)
        assert 0 < (~got).sum() < keep.sum() and not (~got & ~keep).any()
    with pytest.raises(ValueError):
        masks.mask(a, "REMOVE_MOST_UNSTABLE", 25)
    moved = masks.projected(low, 2, (3.0, -2.0, 0.0))
    assert moved[0].shape == (40, 40) and moved[1].shape == (20, 20) and np.array_equal(moved[0][8:30, 8:30], low[10:32, 5:27])
    assert np.isnan(masks.dual_trust(steady, steady + 1, steady > 3)[0, 0])


def test_temporal_scores_find_the_pixels_that_change(spark):
    from driftlake import engine

    moves = [(0.0, 0.0)] * 8
    p = _recording(spark, moves, 32)
    noisy = [list(r.pixels) for r in p.orderBy("frame").collect()]
    rng = np.random.default_rng(4)
    for a in noisy:
        for y in range(4, 12):
            for x in range(4, 12):
                a[32 * y + x] *= float(np.exp(rng.normal()))
    q = spark.createDataFrame([("r", t, 32, 32, a) for t, a in enumerate(noisy)], p.schema)
    poses = spark.createDataFrame([("r", t, 0.0, 0.0, 0.0) for t in range(8)], "recording_id string, frame int, x double, y double, theta double")
    r = engine.temporal_scores(q, poses, (1, 2)).first()
    s = np.array(r.instability).reshape(32, 32)
    assert s[7, 7] > 3 * s[24, 24]
    m = engine.pixel_masks(q, "REMOVE_MOST_UNSTABLE", 10, poses, (1, 2)).first().mask
    gone = ~np.unpackbits(np.frombuffer(m, np.uint8)).reshape(32, 32).astype(bool)
    assert gone[4:12, 4:12].sum() > 0.7 * gone.sum() > 0


def test_masked_and_warm_passes_and_shift_bound(spark):
    from driftlake import engine

    moves = [(0.8 * t, -0.5 * t) for t in range(6)]
    p = _recording(spark, moves, noise=5)
    for more in ({"mask": "REMOVE_LEAST_INFORMATIVE"}, {"mask": "STRATIFIED_LOWEST_ANCHOR_TRUST"}, {"warm": True}, {"weighting": "COMBINED"}, {"weighting": "UNCERTAINTY"}):
        t, pairs = engine.estimate(p, fit.Options(max_shift=6), lags=(1, 2), **more)
        assert max(np.hypot(r.dx - moves[r.frame][0], r.dy - moves[r.frame][1]) for r in t.collect()) < 0.1
        assert pairs.where("status = 'OK'").count() >= 8
    b = engine.shift_bound(p, lags=(1, 2)).first()
    assert b.resolution == 2.0 and b.suggested == 30.0 and abs(b.largest - 2 * np.hypot(0.8, 0.5)) < 1 and b.pairs == 9


def test_known_graphs():
    """Hand-made graphs with their known solutions, a reversed edge and a frame without support among them."""
    edges = [(0, 1, 1.25, -0.5, 0), (1, 2, 0.75, 0.25, 0), (0, 2, 2.1, -0.2, 0), (3, 2, -0.4, 0.3, 0)]
    got = solve.reconciled(5, edges, rotation=False)
    want = [(0, 0), (77 / 60, -29 / 60), (31 / 15, -13 / 60), (37 / 15, -31 / 60), (0, 0)]
    assert np.allclose(got["poses"][:, :2], want, atol=1e-7) and got["support"].tolist() == [3, 2, 3, 1, 0]
    good = [(0, 1, 1, 0, 0), (1, 2, 1, 0, 0), (2, 3, 1, 0, 0)]
    cov = [np.eye(2) * 0.01] * 3 + [np.eye(2) * 100.0]
    got = solve.reconciled(4, [*good, (0, 3, 9, 0, 0)], "UNCERTAINTY", covariances=cov, rotation=False)
    assert abs(got["poses"][3, 0] - 3) < 0.01


def test_plain_least_squares_checks_the_rank():
    edges = [(0, 1, 1.0, 0.0), (1, 2, 1.0, 1.0), (0, 2, 2.1, 1.0)]
    assert np.allclose(solve.least_squares(3, edges), solve.reconciled(3, [(*e, 0.0) for e in edges], rotation=False)["poses"][:, :2], atol=1e-6)
    with pytest.raises(ValueError, match="rank"):
        solve.least_squares(4, edges)


@pytest.mark.parametrize("name", ["registration_report", "robust_trajectory"])
def test_flagship_queries_give_what_plain_loops_give(spark, sf, name):
    """The registered queries, held against fits of single pairs, dense solutions and repair in plain Python."""
    from driftlake.plans import catalog
    from driftlake.plans.tables import planes

    rows = [r.asDict() for r in catalog.QUERIES[name](spark, sf).collect()]
    some = sorted({r["recording_id"] for r in rows})[:2]
    frames = {i: [np.array(r.plane, np.float32).reshape(8, 8) for r in planes(spark, sf).where(f"recording_id = {i}").orderBy("frame").collect()] for i in some}
    o = fit.Options(max_shift=2.0)
    for i, f in frames.items():
        n, made = len(f), [fit.prepare(a, o) for a in f]
        fits = {(t, t + k): fit.log_ratio(made[t], made[t + k], o) for t in range(n) for k in (1, 2, 4, 8, 16) if t + k < n}
        used = [(a, b, x.dx, x.dy, x.theta) for (a, b), x in sorted(fits.items()) if x.usable]
        info, factors = np.tile(np.eye(2), (len(used), 1, 1)), np.ones(len(used))
        if name == "robust_trajectory":
            bridge, last = solve.bridges(n, [e[:2] for e in used]), None
            for _ in range(8):
                x = dense(n, used, info, factors)
                r = []
                for k, (a, b, dx, dy, _) in enumerate(used):
                    y = x if bridge[k] else dense(n, used, info, factors, k)
                    r.append(np.hypot(*(y[b] - y[a] - [dx, dy])) / np.sqrt(2))
                r = np.array(r)
                mid = np.sort(r)[len(r) // 2]
                limit = 1.345 * max(1e-6, 1.4826 * np.sort(np.abs(r - mid))[len(r) // 2])
                over = r - mid
                new = np.array([np.clip(limit / v, 0.05, 1) if v > limit else 1.0 for v in over])
                still = last is not None and np.hypot(*(x - last).T).max() <= 1e-5
                done = np.abs(new - factors).max() <= 1e-4 and still
                factors, last = new, x
                if done:
                    break
        x = dense(n, used, info, factors)
        step = np.hypot(*np.diff(x, axis=0).T)
        med = np.sort(step)[len(step) // 2]
        mad = np.sort(np.abs(step - med))[len(step) // 2]
        far = max(med + 6 * 1.4826 * mad, 6 * med)
        support = np.bincount([e[k] for e in used for k in (0, 1)], minlength=n)
        trusted = np.array([t == 0 or support[t] > 0 and not (n > 4 and step[t - 1] > far) for t in range(n)])
        at = np.flatnonzero(trusted)
        poses = np.stack([np.interp(np.arange(n), at, x[at, k]) for k in (0, 1)], axis=1)
        own = sorted((r for r in rows if r["recording_id"] == i), key=lambda r: r.get("frame", 0))
        if name == "robust_trajectory":
            assert len(own) == n and np.allclose([(r["dx"], r["dy"]) for r in own], poses, atol=2e-5)
            assert [r["repair"] is None for r in own] == trusted.tolist()
            continue
        (r,) = own
        owner = [min((x for (a, b), x in fits.items() if b == t), key=lambda x: [b - a for (a, b), y in fits.items() if y is x][0]) for t in range(1, n)]
        mid = lambda c: sorted(getattr(x, c) for x in owner if np.isfinite(getattr(x, c)))[len(owner) // 2]  # noqa: E731, B023
        assert (r["frames"], r["pairs"], r["repaired"], r["refused"]) == (n, len(fits), n - len(at), len(fits) - len(used))
        assert r["at_bound"] == sum(x.status.startswith("AT") for x in fits.values())
        assert np.allclose([r["largest_move"], r["residual_before"], r["residual_after"]], [np.hypot(*poses.T).max(), mid("residual_before"), mid("residual_after")], atol=2e-5)


def test_known_rotation_events(spark):
    from driftlake import engine

    turns = [0.0 if t < 4 else 0.05 for t in range(8)]
    rows = [("r", t, 64, 64, analytic(0.35 * t, -0.22 * t, turns[t], gain=2 ** (-t / 20), w=64).ravel().tolist()) for t in range(8)]
    p = spark.createDataFrame(rows, "recording_id string, frame int, height int, width int, pixels array<float>")
    events = spark.createDataFrame([("r", 4)], "recording_id string, event_frame int")
    o = fit.Options(max_shift=8, max_rotation=np.radians(5))
    (e,) = engine.event_rotations(p, events, o, 2).collect()
    assert abs(e.delta - 0.05) < 0.002 and (e.pairs, e.status) == (4, "OK") and e.usable == 4
    t, pairs = engine.estimate(p, o, lags=(1, 2, 4), events=events, event_window=2)
    got = sorted(t.collect(), key=lambda r: r.frame)
    assert all(abs(r.theta - turns[r.frame]) < 0.003 for r in got)
    assert max(np.hypot(r.dx - 0.35 * r.frame, r.dy + 0.22 * r.frame) for r in got) < 0.15
    few = solve.event_turn([0.1, 0.1], [1, 1], 0.2)
    assert few["status"] == "INSUFFICIENT_SUPPORT" and np.isnan(few["delta"])
