"""Actions by name: what the engine offers to programs, with checked arguments and results as JSON envelopes."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake import batch, engine
from driftlake.operators.recipes import IMAGES, MOTIONS, recommend
from driftlake.sources import tiff

#: Rows that an envelope holds; more stay in the DataFrame that the action gives beside it.
MOST = 1000


@dataclass(frozen=True)
class Action:
    name: str
    text: str
    run: Callable[..., Any]
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    writes: bool = False


def plain(x: Any) -> Any:
    """What JSON can hold; numbers that are not finite are null."""
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x if x is None or isinstance(x, (bool, int, str)) else str(x)


def _planes(spark: SparkSession, path: str) -> DataFrame:
    p = tiff.scan(spark, path).where("status = 'ok'")
    return p.select(F.col("path").alias("recording_id"), "frame", "c", "z", "height", "width", "pixels")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.limit(MOST).collect()]


def _inspect(spark, path):
    return _rows(tiff.scan(spark, path).groupBy("path", "status", "height", "width", "dtype").agg(F.countDistinct("frame").alias("frames"), F.countDistinct("c").alias("channels"), F.countDistinct("z").alias("slices"), F.max("message").alias("message")).orderBy("path"))


def _discover(spark, folder, recursive=False):
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").option("recursiveFileLookup", recursive).load(folder).select("path")
    return [r.path for r in names.where(~F.lower("path").rlike(r"_registered\.tiff?$|\.part\.tif$")).orderBy(F.lower("path")).limit(MOST).collect()]


def _rank(spark, path):
    return _rows(engine.localisability(_planes(spark, path).where("z = 0")).orderBy("recording_id", "rank"))


def _recommend(spark, image, motion):
    out = recommend(image, motion)
    return {**{k: v for k, v in out.items() if k != "options"}, **vars(out["options"])}


def _estimate(spark, path, channel=1, image="PHASE_CONTRAST", motion="SUBPIXEL_RANDOM_WALK"):
    choice = recommend(image, motion)
    t, _ = engine.estimate(_planes(spark, path), choice.pop("options"), channel=channel, **choice)
    return _rows(t.orderBy("recording_id", "frame"))


def _batch(spark, source, target, image="PHASE_CONTRAST", motion="SUBPIXEL_RANDOM_WALK", overwrite=False, recursive=False):
    return _rows(batch.register_batch(spark, source, target, image, motion, overwrite, recursive).orderBy("path"))


ACTIONS = {
    a.name: a
    for a in (
        Action("inspect_tiff", "Size, axes and kind of pixels of TIFF files.", _inspect, ("path",)),
        Action("discover_tiffs", "TIFF files of a folder, without earlier results.", _discover, ("folder",), ("recursive",)),
        Action("rank_channels", "Channels by how well a move can be located in them.", _rank, ("path",)),
        Action("recommend", "The recipe for a type of image and of motion.", _recommend, ("image", "motion")),
        Action("estimate", "Movement and repairs, without writing pixels.", _estimate, ("path",), ("channel", "image", "motion")),
        Action("register", "One stack registered and written.", _batch, ("source", "target"), ("image", "motion", "overwrite"), writes=True),
        Action("register_batch", "All stacks of a folder registered; a bad file is a row.", _batch, ("source", "target"), ("image", "motion", "overwrite", "recursive"), writes=True),
    )
}


def call(spark: SparkSession, name: str, arguments: dict[str, Any], confirm: bool = False) -> str:
    """A JSON envelope: {"ok", "action", "result"} or {"ok", "action", "error"}; an action that writes needs `confirm` to overwrite."""
    try:
        if name not in ACTIONS:
            raise ValueError(f"unknown action {name}")
        a = ACTIONS[name]
        missing, odd = [k for k in a.needs if k not in arguments], [k for k in arguments if k not in (*a.needs, *a.may)]
        if missing or odd:
            raise ValueError(f"missing arguments {missing}, unknown arguments {odd}")
        if a.writes and arguments.get("overwrite") and not confirm:
            raise ValueError("overwriting has to be confirmed")
        body = {"ok": True, "action": name, "result": plain(a.run(spark, **arguments))}
    except Exception as e:  # an envelope says what went wrong
        body = {"ok": False, "action": name, "error": f"{type(e).__name__}: {e}"[:500]}
    return json.dumps(body)


def search(words: str) -> list[dict]:
    """Actions and enumerations whose name or text has all words, best first."""
    wanted = words.lower().split()
    notes = [(a.name, a.text, "action") for a in ACTIONS.values()] + [(v, f"image type {v}", "image") for v in IMAGES] + [(v, f"motion type {v}", "motion") for v in MOTIONS]
    hits = [(sum(w in n.lower() for w in wanted), n, t, k) for n, t, k in notes if all(w in f"{n} {t}".lower() for w in wanted)]
    return [{"name": n, "text": t, "kind": k} for _, n, t, k in sorted(hits, key=lambda h: (-h[0], h[1]))]
