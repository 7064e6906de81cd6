"""Calendar trends and fixed-length axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwatch.functions.times import parse_time


def calendar_counts(df: DataFrame, ts: Column, count: str = "crime_count") -> DataFrame:
    """Count per year, month, day of week (1 = Sunday) and hour; a null time is a group of nulls."""
    parts = df.select(
        F.year(ts).alias("year"), F.month(ts).alias("month"), F.dayofweek(ts).alias("day_of_week"), F.hour(ts).alias("hour")
    )
    return parts.groupBy("year", "month", "day_of_week", "hour").agg(F.count("*").alias(count))


def crime_trends(crimes: DataFrame) -> DataFrame:
    return calendar_counts(crimes, parse_time("date"))


def monthly(trends: DataFrame, year: int | None = None) -> DataFrame:
    """Roll the trend table up to months, over all years or one."""
    rows = trends if year is None else trends.filter(F.col("year") == year)
    return rows.groupBy("month").agg(F.sum("crime_count").alias("crime_count"))


def densify(df: DataFrame, key: str, last: int, measures: list[str]) -> DataFrame:
    """Rows for every key 1..last, missing sums as 0; other keys are left out.

    The axis is at most ``last`` rows and so is the grouped side, which may be broadcast.
    """
    sums = (
        df.filter(F.col(key).between(1, last))
        .groupBy(F.col(key).cast("int").alias(key))
        .agg(*[F.sum(m).alias(m) for m in measures])
    )
    axis = df.sparkSession.range(1, last + 1, numPartitions=1).select(F.col("id").cast("int").alias(key))
    full = axis.join(F.broadcast(sums), key, "left")
    return full.select(key, *[F.coalesce(F.col(m), F.lit(0).cast(sums.schema[m].dataType)).alias(m) for m in measures])
