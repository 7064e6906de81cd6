"""Connected components of an edge table, by alternating stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatwatch.session import shared_dir


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id, component`` for every end of an edge ``u, v``: the smallest id reachable.

    Each round hangs the larger neighbours of a node on its least neighbour, then its smaller ones; the
    rounds needed grow with the logarithm of the longest path. A hub is never gathered: its least
    neighbour is an aggregate and comes back by a join. Every round is written to the shared folder.
    """
    spark = edges.sparkSession
    where = shared_dir(spark, "components")
    edges.select("u", "v").filter("u <> v").distinct().write.parquet(f"{where}/0")
    now = spark.read.parquet(f"{where}/0")
    state = _state(now)
    for turn in range(1, most_rounds + 1):
        if not state[0]:
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # every edge now points from the larger to the smaller id
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small.filter("u <> v").distinct().write.parquet(f"{where}/{turn}")
        now = spark.read.parquet(f"{where}/{turn}")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
