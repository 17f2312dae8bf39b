"""Folder batches: every TIFF stack of a folder registered in one job; a bad file is a row of the report."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake import engine
from driftlake.operators.recipes import recommend
from driftlake.sources import tiff


def _stem(path):
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def register_batch(spark: SparkSession, source: str, target: str, image: str = "PHASE_CONTRAST", motion: str = "SUBPIXEL_RANDOM_WALK", overwrite: bool = False, recursive: bool = False, interpolation: str = "BILINEAR", crop: bool = True) -> DataFrame:
    """The report: (path, status completed | skipped | error, frames, out, repaired, residual_before, residual_after, message)."""
    choice = recommend(image, motion)
    planes = tiff.scan(spark, source, recursive)
    if not overwrite:
        # names of the results that are there already; contents are not read
        there = spark.read.format("binaryFile").option("pathGlobFilter", "*_registered.tif").load(target) if _has_files(spark, target) else None
        if there is not None:
            done = there.select(F.regexp_replace(_stem(F.col("path")), "_registered$", "").alias("stem")).distinct()
            planes = planes.withColumn("stem", _stem(F.col("path"))).join(done.withColumn("done", F.lit(True)), "stem", "left").drop("stem")
    if "done" not in planes.columns:
        planes = planes.withColumn("done", F.lit(None).cast("boolean"))
    todo = planes.where(F.col("done").isNull() & (F.col("status") == "ok"))
    p = todo.select(F.col("path").alias("recording_id"), "frame", "height", "width", "pixels")
    trajectory, pairs = engine.estimate(p, choice["options"], **{k: v for k, v in choice.items() if k != "options"})
    moved = engine.apply_transforms(p, trajectory, interpolation, crop)
    kinds = todo.select("path", "frame", "dtype")
    out = tiff.write(moved.withColumnRenamed("recording_id", "path").join(kinds, ["path", "frame"]), target)
    rep = engine.report(trajectory, pairs).withColumnRenamed("recording_id", "path").select("path", "repaired", "residual_before", "residual_after")
    completed = out.join(rep, "path", "left").select("path", F.lit("completed").alias("status"), "frames", "out", "repaired", "residual_before", "residual_after", F.lit(None).cast("string").alias("message"))
    rest = planes.where(F.col("done").isNotNull() | (F.col("status") != "ok")).groupBy("path").agg(F.max("done").alias("done"), F.max("message").alias("message"))
    rest = rest.select("path", F.when(F.col("done"), "skipped").otherwise("error").alias("status"), F.lit(None).cast("int").alias("frames"), F.lit(None).cast("string").alias("out"), F.lit(None).cast("long").alias("repaired"), F.lit(None).cast("double").alias("residual_before"), F.lit(None).cast("double").alias("residual_after"), "message")
    return completed.unionByName(rest)


def _has_files(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*_registered.tif")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def main(args: list[str] | None = None) -> int:
    """driftlake source target [--image X] [--motion Y] [--overwrite] [--recursive]; 1 if a file failed."""
    a = argparse.ArgumentParser(prog="driftlake", description=main.__doc__)
    a.add_argument("source")
    a.add_argument("target")
    a.add_argument("--image", default="PHASE_CONTRAST")
    a.add_argument("--motion", default="SUBPIXEL_RANDOM_WALK")
    a.add_argument("--interpolation", default="BILINEAR")
    a.add_argument("--overwrite", action="store_true")
    a.add_argument("--recursive", action="store_true")
    a.add_argument("--no-crop", action="store_true")
    o = a.parse_args(args)
    spark = SparkSession.builder.appName("driftlake").getOrCreate()
    rep = register_batch(spark, o.source, o.target, o.image, o.motion, o.overwrite, o.recursive, o.interpolation, not o.no_crop)
    path = f"{o.target}/report"
    rep.write.mode("overwrite").option("header", True).csv(path)
    return int(not spark.read.option("header", True).csv(path).where("status = 'error'").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
