"""Result tables as CSV: scans whose header decides the columns, transforms, and the report of a folder batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the report of a folder batch: a fixed format.
BATCH = ("input", "output", "status", "elapsed_seconds", "residual_before", "residual_after", "recipe", "error", "rotation_mode", "rotation_events", "rotation_event_window", "rotation_event_results")

#: Columns of the long report of a folder batch: a fixed format.
BATCH_LONG = (
    "input_file", "output_file", "status", "elapsed_seconds", "median_residual_before", "median_residual_after", "selection_mode", "resolved_recipe_id", "resolved_recipe",
    "rotation_recipe_id", "rotation_recipe", "rotation_proposal", "rotation_selector_step90", "fit_rotation", "max_rotation_degrees", "minimum_rotation_residual_gain",
    "rotation_accepted_pairs", "rotation_declined_pairs", "max_recovered_rotation_degrees", "selection_details", "rotation_selection_details", "error", "rotation_mode",
    "rotation_events", "rotation_event_window", "rotation_event_results",
)


def scan_csv(spark: SparkSession, path: str, numbers: tuple[str, ...] = (), extra: bool = True) -> DataFrame:
    """Rows of CSV files with a header, as text; `numbers` as doubles, null where a field is empty or no number."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    missing = [c for c in numbers if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing}")
    out = df.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in numbers})
    return out if extra else out.select(*numbers)


def blank(c: Column) -> Column:
    """Text of a value; empty where there is none or it is not finite."""
    return F.coalesce(F.when(F.lower(c.cast("string")).isin("nan", "infinity", "-infinity"), F.lit("")).otherwise(c.cast("string")), F.lit(""))


def transforms(trajectory: DataFrame) -> DataFrame:
    """Rows of the transform table: frames from 1, angles in degrees, in order."""
    return trajectory.select(
        "recording_id", (F.col("frame") + 1).alias("frame"), "dx", "dy", F.degrees("theta").alias("theta_degrees"), blank(F.col("repair")).alias("repair"),
    ).orderBy("recording_id", "frame")


def batch_rows(report: DataFrame, recipe: str, rotation_mode: str = "OFF") -> DataFrame:
    """The twelve columns of the batch report, from the rows that register_batch gives."""
    have = set(report.columns)
    at = lambda c: blank(F.col(c)) if c in have else F.lit("")
    return report.select(
        F.col("path").alias("input"), at("out").alias("output"), F.col("status"), F.format_string("%.6f", F.coalesce(F.col("elapsed_seconds") if "elapsed_seconds" in have else F.lit(None).cast("double"), F.lit(0.0))).alias("elapsed_seconds"),
        at("residual_before").alias("residual_before"), at("residual_after").alias("residual_after"), F.lit(recipe).alias("recipe"), at("message").alias("error"),
        F.lit(rotation_mode).alias("rotation_mode"), at("rotation_events").alias("rotation_events"), at("rotation_event_window").alias("rotation_event_window"), at("rotation_event_results").alias("rotation_event_results"),
    )


def batch_long_rows(report: DataFrame, **known: object) -> DataFrame:
    """The 26 columns of the long batch report; `known` sets columns that are the same for all files, others are empty."""
    odd = [c for c in known if c not in BATCH_LONG]
    if odd:
        raise ValueError(f"no column {odd}")
    short = batch_rows(report, str(known.get("resolved_recipe", "")), str(known.get("rotation_mode", "OFF")))
    names = {"input_file": "input", "output_file": "output", "median_residual_before": "residual_before", "median_residual_after": "residual_after", "resolved_recipe": "recipe"}
    at = lambda c: F.col(names.get(c, c)) if names.get(c, c) in BATCH else F.lit("" if c not in known else str(known[c]))
    return short.select(*[at(c).alias(c) for c in BATCH_LONG])


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV table with a header, in as many files as the rows have partitions; empty texts stay empty."""
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
