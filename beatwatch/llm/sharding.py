"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwatch.session import shared_dir

# rows that one task numbers; the count of number ranges follows the row count
ROWS_PER_RANGE = 1_000_000


def unit_interval(*parts: Column) -> Column:
    """A repeatable number in (0, 1) from the hash of the parts."""
    top = F.shiftrightunsigned(F.xxhash64(*parts), 11)
    return (top.cast("double") + 0.5) / F.lit(float(1 << 53))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard that wins the key: each shard draws -ln(u)/weight from (key, shard), the least draw wins.

    A draw depends on nothing but key and shard, so a new shard takes only the keys it wins, and a
    removed shard gives up only its own. A shard of weight 0 takes nothing; a null key is a key like others.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be 0 or more, one of them above 0")
    named = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    draws = [
        F.struct((F.log(unit_interval(named, F.lit(shard))) / F.lit(float(w))).alias("draw"), F.lit(-shard).alias("shard"))
        for shard, w in enumerate(weights)
        if w > 0
    ]
    best = draws[0] if len(draws) == 1 else F.greatest(*draws)
    return (-best["shard"]).cast("int")


def shard_rows(
    df: DataFrame,
    key: str,
    weights: Sequence[float],
    *,
    grown: Sequence[float] | None = None,
    payload: Sequence[Column] = (),
) -> DataFrame:
    """Key, payload columns, ``shard``, ``slot`` and ``grown_shard`` of every row.

    ``slot`` numbers the rows of a shard without gaps from 0. Rows of a shard are dealt over number
    ranges by a hash that includes the payload; a range is numbered by one task, and starts where the
    counts of the ranges before it end. The narrow rows are written to the shared folder first, so
    that counts and numbers see the same rows after a lost executor.

    Null keys go to one shard of their own key; equal rows get different slots; an empty table gives
    no rows. A key or row that repeats without end stays in its shard (the law is by key) and is split
    over ranges by its place in the scan. Columns named like the results are replaced.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark, 'shards')}/rows"
    win = rendezvous(df[key], weights)
    more = rendezvous(df[key], grown) if grown is not None else F.lit(None).cast("int")
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))
    df.select(df[key], *payload, win.alias("shard"), more.alias("grown_shard"), place.alias("_place")).write.parquet(where)
    rows = spark.read.parquet(where)
    ranges = max(1, math.ceil(rows.count() / ROWS_PER_RANGE))
    rows = rows.withColumn("_range", F.floor(F.col("_place") * F.lit(ranges) / F.lit(1 << 30)).cast("int"))
    sizes = rows.groupBy("shard", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_range").orderBy(F.xxhash64(key), key, "_place")
    numbered = rows.withColumn("_nth", F.row_number().over(within)).join(first, ["shard", "_range"])
    return numbered.withColumn("slot", F.col("_first") + F.col("_nth") - 1).drop("_range", "_place", "_n", "_nth", "_first")
