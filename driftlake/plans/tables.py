"""The given tables as the engine's domain: recordings of tiny planes, trajectories, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.operators.planning import number_frames


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, frame, plane of 8 x 8): a recording for each label of `embeddings`."""
    e = read(spark, sf_dir, "embeddings").select(F.col("label").alias("recording_id"), "vec_id", F.col("embedding").alias("plane"))
    return number_frames(e, "recording_id", ["vec_id"]).select("recording_id", "frame", "plane")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes(spark, sf_dir).select("recording_id", "frame")


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, frame, x, y): a trajectory for each user of `events`; the value is x, its tenth part modulo 7 is y."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), "ts", "event_id", "event_type", F.col("value").alias("x"))
    e = number_frames(e, "recording_id", ["ts", "event_id"])
    return e.select("recording_id", "frame", "event_type", "x", (F.col("x") / 10 % 7).alias("y"))


#: The same in DuckDB.
PLANES_SQL = "SELECT label AS recording_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding AS plane FROM embeddings"
POSES_SQL = """SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type, value AS x,
  value / 10 % 7 AS y FROM events"""
#: Result rows: acquisition = customer, kind = order priority, method = line status, metric = price by quantity.
RESULTS_SQL = """SELECT l_orderkey, l_linenumber, l_returnflag AS condition, l_linestatus AS method, o_orderpriority AS kind, o_custkey AS cluster,
  l_extendedprice / l_quantity AS metric, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_extendedprice", "l_quantity", "l_discount")
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("condition"), F.col("l_linestatus").alias("method"), F.col("o_orderpriority").alias("kind"),
        F.col("o_custkey").alias("cluster"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("metric"), "l_discount",
    )
