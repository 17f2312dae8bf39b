import numpy as np

from driftlake import batch
from driftlake.sources import tiff


def _stack(move):
    rng = np.random.default_rng(3)
    base = np.kron(rng.integers(40, 200, (14, 14)), np.ones((6, 6)))
    return [np.roll(base, move * t, axis=1)[10:74, 10:74].astype(np.uint16) for t in range(3)]


def test_folder_batch_isolates_and_skips(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.tif").write_bytes(tiff.encode(_stack(1)))
    (src / "bad.tif").write_bytes(b"nothing")
    first = {r.path.rsplit("/", 1)[1]: r for r in batch.register_batch(spark, str(src), f"file://{out}", "fiducial static", "steady directional drift").collect()}
    assert first["a.tif"].status == "completed" and first["a.tif"].frames == 3 and first["bad.tif"].status == "error"
    pages = tiff.decode((out / "a_registered.tif").read_bytes())
    assert len(pages) == 3 and pages[0].dtype == np.uint16
    again = {r.path.rsplit("/", 1)[1]: r.status for r in batch.register_batch(spark, str(src), f"file://{out}", "fiducial static", "steady directional drift").collect()}
    assert again == {"a.tif": "skipped", "bad.tif": "error"}
