"""Sources, sinks, actions and Fourier turns."""

import json
import struct
import zlib

import numpy as np
import pytest

from driftlake.kernels import planes as kp
from driftlake.sources import raw, reports, tiff
from tests.test_registration import analytic


def lzw(data):
    """Packs by the published rules: a clear code first, widths that grow early, a clear code when the table is full."""
    bits, words, free, width, w = "", {}, 258, 9, b""
    bits += f"{256:0{width}b}"
    code = lambda x: x[0] if len(x) == 1 else words[x]
    for k in range(len(data)):
        c = data[k : k + 1]
        if w and w + c not in words:
            bits += f"{code(w):0{width}b}"
            words[w + c], free, w = free, free + 1, b""
            if free == 4094:
                bits += f"{256:0{width}b}"
                words, free, width = {}, 258, 9
            elif free > (1 << width) - 1:
                width += 1
        w += c
    bits += f"{code(w):0{width}b}"
    width += free + 1 > (1 << width) - 1
    bits += f"{257:0{width}b}"
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def packed(page, how, said=b""):
    """A one-page TIFF whose strip is compressed."""
    body = {5: lzw, 8: zlib.compress, 32773: lambda b: b"".join(bytes([min(len(b) - i, 128) - 1]) + b[i : i + 128] for i in range(0, len(b), 128))}[how](page.tobytes())
    tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, page.itemsize * 8), (259, 3, how), (273, 4, 8), (277, 3, 1), (279, 4, len(body)), (339, 3, 1)]
    at = 8 + len(body) + len(body) % 2
    tail = at + 2 + 12 * (len(tags) + bool(said)) + 4
    out = b"II*\0" + struct.pack("<I", at) + body + b"\0" * (len(body) % 2)
    rows = [struct.pack("<HHII", t, k, 1, v) for t, k, v in tags]
    if said:
        rows.append(struct.pack("<HHII", 270, 2, len(said), tail))
    return out + struct.pack("<H", len(rows)) + b"".join(sorted(rows, key=lambda r: struct.unpack("<H", r[:2]))) + b"\0\0\0\0" + said


@pytest.mark.parametrize("how", [5, 8, 32773])
@pytest.mark.parametrize("w", [4, 32, 120])
def test_compressed_pages(how, w):
    page = (analytic(w=w) / 10).astype(np.uint16)
    assert np.array_equal(tiff.decode(packed(page, how))[0], page)
    assert not tiff.decode(packed(page * 0, how))[0].any()


def test_axes():
    assert tiff.axes("", 3) == [(0, 0, 0), (1, 0, 0), (2, 0, 0)]
    assert tiff.axes("ImageJ=1\nchannels=2\nframes=2\n", 4) == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0)]
    ome = '<OME><Image ID="0"><Pixels DimensionOrder="XYZTC" SizeC="2" SizeZ="1" SizeT="2"/></Image></OME>'
    assert tiff.axes(ome, 4) == [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)]
    with pytest.raises(ValueError, match="series"):
        tiff.axes("<Image ><Image >", 1)
    with pytest.raises(ValueError, match="fill"):
        tiff.axes("channels=3\n", 4)


def test_raw_files(spark, tmp_path):
    a = np.arange(24, dtype="<u2")
    (tmp_path / "a.raw").write_bytes(a.tobytes())
    (tmp_path / "b.raw").write_bytes(a.tobytes()[:-1])
    rows = raw.scan(spark, str(tmp_path), 3, 4, "uint16").orderBy("path", "frame").collect()
    assert [(r.frame, r.status) for r in rows] == [(0, "ok"), (1, "ok"), (None, "error")] and list(rows[1].pixels) == list(range(12, 24))
    assert raw.scan(spark, str(tmp_path), 3, 4, "uint16", frames=3).where("status = 'ok'").count() == 0
    with pytest.raises(ValueError):
        raw.scan(spark, str(tmp_path), 3, 4, "complex64")


def test_reports(spark, tmp_path):
    t = spark.createDataFrame([("r", 1, 2.0, float("nan"), np.pi / 2, None), ("r", 0, 0.0, 0.0, 0.0, "OUTLIER_STEP")], "recording_id string, frame int, dx double, dy double, theta double, repair string")
    rows = reports.transforms(t).collect()
    assert [(r.frame, round(r.theta_degrees, 6), r.repair) for r in rows] == [(1, 0.0, "OUTLIER_STEP"), (2, 90.0, "")]
    reports.write_csv(reports.transforms(t), f"{tmp_path}/t")
    back = reports.scan_csv(spark, f"{tmp_path}/t", ("dx", "dy")).orderBy("frame").collect()
    assert back[1].dx == 2.0 and back[0].recording_id == "r"
    with pytest.raises(ValueError):
        reports.scan_csv(spark, f"{tmp_path}/t", ("nothing",))
    rep = spark.createDataFrame([("a.tif", "completed", "o.tif", 0.5, float("nan"), None)], "path string, status string, out string, residual_before double, residual_after double, message string")
    got = reports.batch_rows(rep, "LOG_RATIO_FIT")
    long = reports.batch_long_rows(rep, selection_mode="MANUAL", fit_rotation=False)
    assert tuple(long.columns) == reports.BATCH_LONG and len(reports.BATCH_LONG) == 26 and (long.first().selection_mode, long.first().error) == ("MANUAL", "")
    with pytest.raises(ValueError):
        reports.batch_long_rows(rep, other=1)
    assert tuple(got.columns) == reports.BATCH and got.first()[:6] == ("a.tif", "o.tif", "completed", "0.000000", "0.5", "")


def test_actions(spark, tmp_path):
    from driftlake import actions

    stack = [(analytic(0.5 * t, w=48) / 10).astype(np.uint16) for t in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(tiff.encode(stack))
    call = lambda *a, **k: json.loads(actions.call(spark, *a, **k))
    assert call("inspect_tiff", {"path": f"{tmp_path}/in"})["result"][0]["frames"] == 3
    assert len(call("discover_tiffs", {"folder": f"{tmp_path}/in"})["result"]) == 1
    assert call("recommend", {"image": "phase contrast", "motion": "intermittent-jumps"})["result"]["filter_"] == "GAUSSIAN_0_7"
    est = call("estimate", {"path": f"{tmp_path}/in"})["result"]
    assert len(est) == 3 and abs(est[2]["dx"] - 1) < 0.1
    assert call("register_batch", {"source": f"{tmp_path}/in", "target": f"{tmp_path}/out"})["result"][0]["status"] == "completed"
    assert not call("register_batch", {"source": "x", "target": "y", "overwrite": True})["ok"] and not call("nothing", {})["ok"]
    assert "unknown arguments" in call("recommend", {"image": "x", "motion": "y", "more": 1})["error"]
    assert actions.search("tiff folder")[0]["name"] == "discover_tiffs" and actions.plain({"a": [float("inf")]}) == {"a": [None]}
    assert call("rank_channels", {"path": f"{tmp_path}/in"})["result"][0]["rank"] == 1


def test_fourier_turns():
    a, b = analytic(w=64), analytic(1.5, -0.5, 0.1, w=64)
    w = kp.warp(b, (1.5, -0.5, 0.1), "FOURIER")
    off = np.abs(w[20:-20, 20:-20] / a[20:-20, 20:-20] - 1)  # the border of zeros rings
    assert off.mean() < 0.02 and off.max() < 0.05
