"""Row caps per group without ranking a whole group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatwatch.session import shared_dir


def cap_rows(df: DataFrame, group: str, key: str, n: int, total: int | None = None, digits: int = 4) -> DataFrame:
    """Keep n rows per group, then at most ``total`` rows in all, in the order of the key's digest.

    The digest is uniform, so its first hex digits cut every group, however large, into ``16 ** digits``
    even buckets. The bucket counts, one narrow scan kept as a small table, tell which buckets are kept
    whole and where each cap falls; only the rows of those last buckets are ranked, the 65,536th part of a group at
    the default. ``key`` must be unique within a group.
    """
    spark, names = df.sparkSession, df.columns
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    marked = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, digits))

    stored = shared_dir(spark, "bucket-counts")
    marked.groupBy(group, "_bucket").agg(F.count("*").alias("_rows")).write.parquet(stored)
    counts = spark.read.parquet(stored)

    ahead = F.sum("_rows").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_rows")
    states = counts.withColumn("_fit", F.lit(n) - ahead).filter(F.col("_fit") > 0)
    if total is None:
        states = states.withColumn("_total_fit", F.col("_fit"))
        spans_total = F.lit(False)
    else:
        # one row per bucket, so at most 16 ** digits rows reach the running total
        kept = states.groupBy("_bucket").agg(F.sum(F.least("_fit", "_rows")).alias("_kept"))
        before = F.sum("_kept").over(Window.orderBy("_bucket")) - F.col("_kept")
        open_buckets = kept.withColumn("_total_fit", F.lit(total) - before).filter(F.col("_total_fit") > 0)
        states = states.join(open_buckets, "_bucket")
        spans_total = F.col("_total_fit") < F.col("_kept")
    states = states.select(
        group,
        "_bucket",
        "_fit",
        "_total_fit",
        (F.col("_fit") >= F.col("_rows")).alias("_group_whole"),
        (~spans_total).alias("_total_whole"),
    )
    placed = _null_safe_join(marked, states, [group, "_bucket"])

    whole = F.col("_group_whole") & F.col("_total_whole")
    in_group = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_digest", key))
    in_total = F.row_number().over(Window.partitionBy("_bucket").orderBy("_digest", key))
    ranked = placed.filter(~whole).withColumn("_rank", in_group).filter(F.col("_rank") <= F.col("_fit"))
    fits = ranked.filter("_total_whole")
    if total is not None:
        cut = ranked.filter(~F.col("_total_whole")).withColumn("_rank", in_total)
        fits = fits.unionByName(cut.filter(F.col("_rank") <= F.col("_total_fit")))
    return placed.filter(whole).select(*names).unionByName(fits.select(*names))


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, match).drop(*[f"_r_{k}" for k in keys])
