import numpy as np
import pytest

from driftlake import engine
from driftlake.kernels import filters, fit, planes as kp, solve


def analytic(dx=0.0, dy=0.0, theta=0.0, gain=1.0, w=96):
    y, x = np.mgrid[0:w, 0:w].astype(float)
    c, s, m = np.cos(theta), np.sin(theta), (w - 1) / 2
    px, py = x - m - dx, y - m - dy
    x, y = c * px + s * py + m, -s * px + c * py + m
    u, v = 2 * np.pi * x / w, 2 * np.pi * y / w
    f = np.sin(3 * u + 0.4) * np.cos(2 * v - 0.7) + 0.7 * np.sin(5 * u - 1.1) * np.cos(7 * v + 0.2) + 0.45 * np.cos(11 * u + 0.9) * np.sin(6 * v + 1.3) + 0.3 * np.sin(13 * u + 2.1) + 0.3 * np.cos(9 * v - 0.5)
    return (gain * (2000 + 600 * f)).astype(np.float32)


@pytest.mark.parametrize(("name", "tol"), [("LOG_RATIO_FIT", 0.05), ("AREA_CORRELATION", 0.05), ("AREA_CORRELATION_NEWTON", 0.05), ("AREA_CORRELATION_ECC", 0.05), ("PHASE_CORRELATION", 0.35)])
@pytest.mark.parametrize("move", [(0.0, 0.0), (2.3, -1.6), (-5.25, 3.75)])
def test_estimators_recover_moves(name, tol, move):
    o = fit.Options(estimator=name, max_shift=8)
    a, b = (fit.prepare(analytic(*m, gain=g), o) for m, g in (((0, 0), 1.0), (move, 0.5)))
    f = fit.ESTIMATORS[name](a, b, o)
    assert f.usable and np.hypot(f.dx - move[0], f.dy - move[1]) < tol
    if name == "LOG_RATIO_FIT":
        assert abs(f.log_gain + 1) < 0.01 and f.residual_after <= f.residual_before + 1e-9


def test_rotation_and_bounds():
    o = fit.Options(max_shift=6, rotation=True, max_rotation=np.radians(5))
    a, b = fit.prepare(analytic(), o), fit.prepare(analytic(1.5, -0.5, 0.03), o)
    f = fit.log_ratio(a, b, o)
    assert abs(f.theta - 0.03) < 0.002 and np.hypot(f.dx - 1.5, f.dy + 0.5) < 0.1
    o = fit.Options(max_shift=2)
    assert fit.log_ratio(fit.prepare(analytic(), o), fit.prepare(analytic(6, 0), o), o).status.startswith("AT_SHIFT")
    none = fit.prepare(np.full((96, 96), np.nan, np.float32), o)
    assert fit.log_ratio(none, none, o).status == "REFUSED_LOW_OVERLAP"
    for bad in ({"norm": "X"}, {"max_shift": 0}, {"floor": 60, "ceiling": 40}, {"estimator": "NO"}, {"least_valid": 0}):
        with pytest.raises(ValueError):
            fit.Options(**bad)


def test_transform_algebra_and_graph():
    a, b = np.array([1.0, -2.0, 0.3]), np.array([0.5, 0.25, -0.7])
    assert np.allclose(solve.then(a, solve.inverse(a)), 0) and not np.allclose(solve.then(a, b), solve.then(b, a))
    truth = np.array([[0, 0, 0], [2, -1, 0.12], [4.5, 0.75, -0.08], [5.25, 2, 0.2]])
    edges = []
    for i, j in ((0, 1), (1, 2), (0, 2), (3, 1), (2, 3)):
        edges.append((i, j, *solve.then(solve.inverse(truth[i]), truth[j])))
    poses, support = solve.multilag(4, edges)
    assert np.allclose(poses, truth, atol=1e-6) and support.tolist() == [3, 3, 3, 2]
    line = [(i, j, float(j - i), 0.0, 0.0) for i in range(8) for j in range(i + 1, min(8, i + 4))]
    bad = [*line, (0, 7, 20.0, 5.0, 0.0)]
    assert abs(solve.robust(8, bad)[0][7, 0] - 7) < abs(solve.multilag(8, bad)[0][7, 0] - 7)
    poses, support = solve.multilag(5, [(0, 1, 1.25, -0.5, 0), (1, 2, 0.75, 0.25, 0), (0, 2, 2.1, -0.2, 0), (3, 2, -0.4, 0.3, 0)])
    assert support[4] == 0 and np.allclose(poses[4], 0)


@pytest.mark.parametrize("how", ["NONE", "BILINEAR", "BICUBIC", "FOURIER"])
def test_warp_undoes_moves(how):
    a, b = analytic(), analytic(3, -2)
    w = kp.warp(b, (3.0, -2.0, 0.0), how)
    assert np.allclose(w[8:-8, 8:-8], a[8:-8, 8:-8], rtol=2e-3 if how == "FOURIER" else 1e-5)
    u = (a / 20).astype(np.uint8)
    assert kp.warp(u, (1.0, 0.0, 0.0), "NONE")[5, 5] == u[5, 6]


@pytest.mark.parametrize("name", ["NONE", "GAUSSIAN_0_7", "GAUSSIAN_1_0", "GAUSSIAN_1_4", "MEDIAN_3X3", "ANSCOMBE", "ANSCOMBE_GAUSSIAN_1_0", "UNSHARP_0_5", "LOCAL_CONTRAST_1_8", "LOCAL_CONTRAST_1_16", "STRUCTURAL_GRADIENT"])
def test_filters(name):
    a = analytic(w=40)
    out = filters.apply(a, name)
    assert out.shape == a.shape and np.isfinite(out).all()
    flat = filters.apply(np.full((20, 20), 7.0, np.float32), name)
    assert np.ptp(flat) < 1e-4
    assert abs(filters.area_average(a, 0.8).mean() - a.mean()) < 1


def _planes(spark, moves, w=64, name="r"):
    rows = [(name, t, w, w, analytic(x, y, gain=2 ** (-t / 20), w=w).ravel().tolist()) for t, (x, y) in enumerate(moves)]
    return spark.createDataFrame(rows, "recording_id string, frame int, height int, width int, pixels array<float>")


def test_register_end_to_end(spark):
    moves = [(0.4 * t, -0.25 * t) for t in range(8)]
    p = _planes(spark, moves).unionByName(_planes(spark, [(0, 0)] * 3, name="still"))
    done, t = engine.register(p, interpolation="BICUBIC", options=fit.Options(max_shift=6), lags=(1, 2, 4))
    got = {(r.recording_id, r.frame): r for r in t.collect()}
    assert len(got) == 11
    for i, (x, y) in enumerate(moves):
        assert np.hypot(got["r", i].dx - x, got["r", i].dy - y) < 0.05
    rows = sorted((r for r in done.where("recording_id = 'r'").collect()), key=lambda r: r.frame)
    a, b = (np.array(rows[i].pixels) / np.mean(rows[i].pixels) for i in (0, 7))
    assert rows[0].height < 64 and np.abs(a - b).mean() < 0.01
    for ref in ("CONSECUTIVE", "FIXED"):
        t2, pairs = engine.estimate(p, fit.Options(max_shift=6), reference=ref)
        assert max(np.hypot(r.dx - moves[r.frame][0], r.dy - moves[r.frame][1]) for r in t2.where("recording_id = 'r'").collect()) < 0.1
        assert {r.recording_id for r in engine.report(t2, pairs).collect()} == {"r", "still"}


def test_channels_and_slices(spark):
    rows = [("r", 0, c, z, 2, 2, [float(c + z), float(-c), 1.0, float(z)]) for c in (0, 1) for z in (0, 1, 2)]
    p = spark.createDataFrame(rows, "recording_id string, frame int, c int, z int, height int, width int, pixels array<float>")
    assert engine.estimation_planes(p, 2, 0).first().pixels == [3.0, -1.0, 1.0, 2.0]
    assert engine.estimation_planes(p, 1, 2).first().pixels == [1.0, 0.0, 1.0, 1.0]
    rng = np.random.default_rng(1)
    frames = [("r", t, c, 0, 48, 48, (analytic(0.2 * t, w=48) if c == 0 else rng.random((48, 48))).ravel().astype(float).tolist()) for t in range(3) for c in (0, 1)]
    q = spark.createDataFrame(frames, "recording_id string, frame int, c int, z int, height int, width int, pixels array<float>")
    assert {r.c: (r.rank, r.poor) for r in engine.localisability(q).collect()} == {0: (1, False), 1: (2, True)}


def test_tiff_folder_isolates_a_bad_file(spark, tmp_path):
    from driftlake.sources import tiff

    stack = [(analytic(t, w=32) / 10).astype(np.uint16) for t in range(3)]
    (tmp_path / "a.tif").write_bytes(tiff.encode(stack))
    (tmp_path / "b.tiff").write_bytes(b"II*\0garbage")
    (tmp_path / "c_registered.tif").write_bytes(tiff.encode(stack))
    rows = tiff.scan(spark, str(tmp_path)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.status) for r in rows) == [("a.tif", "ok")] * 3 + [("b.tiff", "error")]
    ok = tiff.scan(spark, str(tmp_path)).where("status = 'ok'")
    out = tiff.write(ok, f"file://{tmp_path}/out").collect()
    back = tiff.decode(open(out[0].out.removeprefix("file://"), "rb").read())
    assert all(np.array_equal(x, y) for x, y in zip(back, stack, strict=True))


def test_streaming_chain(spark, tmp_path):
    from driftlake.streaming.chain import chain_stream

    schema = "recording_id long, frame int, dx double, dy double"
    for i in range(2):
        spark.createDataFrame([(r, 3 * i + t, 1.0 * r, 0.5) for r in (1, 2) for t in range(3)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    s = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = chain_stream(s).writeStream.format("memory").queryName("chained").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.recording_id, r.frame): (r.x, r.y) for r in spark.table("chained").collect()}
    assert len(got) == 12 and got[2, 5] == (12.0, 3.0)


def test_event_angle_and_recipes():
    from driftlake.operators.recipes import recommend

    a, status = solve.event_angle([0.05, 0.052, 0.049, 1.2], [1, 1, 1, 1], 0.2)
    assert abs(a - 0.05) < 0.01 and status == "OK"
    assert solve.event_angle([0.1], [1], 0.2)[1] == "INSUFFICIENT_SUPPORT"
    assert solve.event_angle([-0.2, 0.0, 0.2, 0.1, -0.1], [1] * 5, 0.2)[1] == "HIGH_DISAGREEMENT"
    got = recommend("sparse low-light fluorescence", "Intermittent jumps")
    assert got["options"].norm == "TUKEY" and got["outlier_mads"] == 0.0
    with pytest.raises(ValueError):
        recommend("x-ray", "jumps")


def test_rolling_template(spark):
    moves = [(0.5 * t, -0.3 * t) for t in range(6)]
    got = engine.rolling(_planes(spark, moves), fit.Options(max_shift=6), window=2).collect()
    assert len(got) == 6 and all(r.support for r in got)
    assert max(np.hypot(r.x - moves[r.frame][0], r.y - moves[r.frame][1]) for r in got) < 0.2
