"""Connected components by alternating large-star and small-star rounds.

Each round rewrites the edge list so that every vertex points at a smaller one; after O(log n) rounds the list is
a forest of stars. Rounds are cut by a Parquet table in the shared folder. Edges never reach the driver; only a
count and a checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.llm.common import drop, materialise


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


#: Edges of a file of a round.
FILE = 250_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of longs to (u, v) with v the least vertex of u's component; only vertices that are not least.

    Self-loops and repeated edges are allowed; an empty list gives an empty list.
    """
    e = materialise(_small(edges), "edges", 1 + edges.count() // FILE)
    before = None
    for _ in range(most_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before or now[0] == 0:
            return e
        before = tuple(now)
        last, e = e, materialise(_small(_large(e)), "edges", 1 + now[0] // FILE)
        drop(last)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
