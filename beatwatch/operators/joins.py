"""Keyed dedup and a left join that heavy keys do not skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """One row per key: the smallest by ``order_by``, then by the remaining columns.

    An aggregate, not a row_number window, so copies of a hot key are merged before the shuffle, by
    sorting each task's rows, as text has no hashed minimum.
    """
    rest = [c for c in df.columns if c != key and c not in order_by]
    kept = F.min(F.struct(*order_by, *rest)).alias("_kept")
    return df.groupBy(key).agg(kept).select(*[key if c == key else F.col(f"_kept.{c}").alias(c) for c in df.columns])


def heavy_keys(df: DataFrame, key: str, share: float = 0.01, tracked: int = 10_000) -> DataFrame:
    """Keys holding more than ``share`` of the rows, found in one pass with a fixed-size sketch.

    At most ``1 / share`` rows, so the result may be broadcast. The answer is approximate;
    callers only use it to spread work, never to decide what is in the result.
    """
    most = int(1 / share)
    top = df.agg(F.expr(f"approx_top_k(`{key}`, {most}, {max(tracked, 10 * most)})").alias("top"), F.count("*").alias("n"))
    return (
        top.select(F.explode("top").alias("t"), "n")
        .filter(F.col("t.count") > F.col("n") * share)
        .select(F.col("t.item").alias(key))
    )


def left_join_one(left: DataFrame, right: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """``left`` join ``right`` on ``key`` where the right side holds one row per key.

    The heavy left keys, at most ``1 / share`` values, are found once, by a job, and stand in the plan as
    literals. Their rows, and those of the null key that never matches, stay where they are and meet the few
    right rows of these keys by broadcast; the rest meets on ``key``. Which keys are found heavy
    never changes the result.
    """
    heavy = [r[0] for r in heavy_keys(left, key, share).filter(F.col(key).isNotNull()).collect()]
    is_heavy = F.col(key).isin(heavy) if heavy else F.lit(False)
    usual = left.filter(F.col(key).isNotNull() & ~is_heavy).join(right.filter(F.col(key).isNotNull() & ~is_heavy), key, "left")
    spread = left.filter(F.col(key).isNull() | is_heavy).join(F.broadcast(right.filter(is_heavy)), key, "left")
    return usual.unionByName(spread)
