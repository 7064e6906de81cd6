"""Summaries of the enriched event table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwatch.functions.severity import CRITICAL_FROM
from beatwatch.functions.text import flag


def clamp(value: int | None, top: int, default: int) -> int:
    """A request parameter: 1..top, anything else is the default."""
    return value if value is not None and 0 < value <= top else default


def moment(as_of: datetime | Column, of: DataFrame | None = None, ts: str = "processed_at") -> Column:
    """The reference time as a column cast to the time column's type."""
    col = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return col.cast(of.schema[ts].dataType) if of is not None else col


def latest(df: DataFrame, ts: str = "processed_at") -> Column:
    """The newest time in the table as a scalar subquery."""
    return df.agg(F.max(ts).alias("t")).scalar()


def _measures(ts: str) -> list[Column]:
    return [
        F.count("*").alias("total_events"),
        F.coalesce(F.avg("severity"), F.lit(0.0)).alias("avg_severity"),
        F.sum(flag(F.col("severity") >= CRITICAL_FROM)).alias("critical_count"),
        F.max(ts).alias("last_seen"),
    ]


def district_summary(events: DataFrame, ts: str = "processed_at") -> DataFrame:
    """Totals per known district, busiest first."""
    rows = events.filter(F.col("district").isNotNull()).groupBy("district").agg(*_measures(ts))
    return rows.orderBy(F.desc("total_events"), F.asc("district"))


def dataset_summary(events: DataFrame, ts: str = "processed_at") -> DataFrame:
    """Totals per dataset, busiest first. Grouped by the raw value: null and 'unknown' stay apart."""
    rows = events.groupBy("source_dataset").agg(*_measures(ts))
    named = rows.withColumn("dataset", F.coalesce("source_dataset", F.lit("unknown"))).drop("source_dataset")
    ordered = named.orderBy(F.desc("total_events"), F.asc("dataset"))
    return ordered.select("dataset", "total_events", "avg_severity", "critical_count", "last_seen")


def since(events: DataFrame, as_of: datetime | Column, seconds: int, ts: str = "processed_at") -> DataFrame:
    """Events strictly newer than ``as_of`` minus a span."""
    return events.filter(F.col(ts) > moment(as_of, events, ts) - F.expr(f"interval {seconds} seconds"))


def hourly_trend(events: DataFrame, as_of: datetime | Column, hours: int | None = None, ts: str = "processed_at") -> DataFrame:
    span = clamp(hours, 168, 24)
    rows = since(events, as_of, span * 3600, ts).groupBy(F.date_trunc("hour", ts).alias("hour"))
    return rows.agg(
        F.count("*").alias("event_count"), F.coalesce(F.avg("severity"), F.lit(0.0)).alias("avg_severity")
    ).orderBy("hour")


def severity_histogram(events: DataFrame) -> DataFrame:
    """Count per severity. Grouped by the raw value: null shows as a second row of level 1."""
    rows = events.groupBy(F.col("severity").alias("_raw")).agg(F.count("*").alias("count"))
    return rows.orderBy(F.asc_nulls_last("_raw")).select(F.coalesce("_raw", F.lit(1)).alias("severity"), "count")


def severity_shares(events: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """Levels 1..5 with count (0 if absent) and percent of all five.

    Level 1 shows the events stored with that level; those with a null severity only stand in
    when there are none. With no stored events at all the live buffer is counted instead.
    """
    raw = events.groupBy(F.col("severity").alias("_raw")).agg(F.count("*").alias("_n"))
    counts = raw.groupBy(F.coalesce("_raw", F.lit(1)).alias("severity")).agg(
        F.min_by("_n", F.col("_raw").isNull()).alias("count")
    )
    if live is not None:
        stored = events.limit(1).agg(F.count("*").alias("n")).scalar()
        waiting = live.filter(stored == 0).groupBy("severity").agg(F.count("*").alias("count"))
        counts = counts.unionByName(waiting)
    # levels are 1..5, so both sides of the join hold five rows at most
    levels = counts.filter(F.col("severity").between(1, 5))
    axis = events.sparkSession.range(1, 6, numPartitions=1).select(F.col("id").cast("int").alias("severity"))
    dense = axis.join(F.broadcast(levels), "severity", "left").select(
        "severity", F.coalesce("count", F.lit(0).cast("long")).alias("count")
    )
    total = levels.agg(F.sum("count").alias("t")).scalar()
    percent = F.when(total > 0, F.round(F.col("count") * 100.0 / total, 2)).otherwise(F.lit(0.0))
    return dense.withColumn("percent", percent)


def rolling_buffer(events: DataFrame, n: int = 150, ts: str = "processed_at", key: str = "event_id") -> DataFrame:
    """The n newest events."""
    return events.orderBy(F.desc_nulls_last(ts), F.asc(key)).limit(n)


def recent_count(events: DataFrame, as_of: datetime | Column, seconds: int = 60, ts: str = "processed_at") -> DataFrame:
    return since(events, as_of, seconds, ts).agg(F.count("*").alias("events_per_min"))


def active_districts(events: DataFrame, as_of: datetime | Column, seconds: int = 300, ts: str = "processed_at") -> DataFrame:
    """Distinct non-empty districts in the last span."""
    rows = since(events, as_of, seconds, ts).filter(F.col("district") != "")
    return rows.agg(F.countDistinct("district").alias("active_districts"))


def critical_in_buffer(events: DataFrame, n: int = 150, ts: str = "processed_at", key: str = "event_id") -> DataFrame:
    slim = events.select(ts, key, "severity")
    return rolling_buffer(slim, n, ts, key).agg(
        F.count_if(F.col("severity") >= CRITICAL_FROM).alias("critical_count")
    )


def event_counters(events: DataFrame) -> DataFrame:
    """Events by (severity, dataset), nulls as 'unknown'; works for batch and complete-mode streams."""
    return events.groupBy(
        F.coalesce(F.col("severity").cast("string"), F.lit("unknown")).alias("severity"),
        F.coalesce("source_dataset", F.lit("unknown")).alias("dataset"),
    ).agg(F.count("*").alias("events_total"))


def topic_counters(messages: DataFrame, topic: str = "topic") -> DataFrame:
    return messages.groupBy(topic).agg(F.count("*").alias("messages_total"))


def totals(events: DataFrame, datasets: tuple[str, ...]) -> DataFrame:
    """All events and events per named dataset, in one pass."""
    return events.agg(
        F.count("*").alias("all_events"),
        *[F.count_if(F.col("source_dataset") == d).alias(d.replace("-", "_")) for d in datasets],
    )


def intensity(summary: DataFrame, measure: str = "total_events", floor: int = 1) -> DataFrame:
    """Share of the busiest row. The maximum is a scalar subquery, not a global window."""
    top = summary.agg(F.greatest(F.max(measure), F.lit(floor)).alias("m")).scalar()
    return summary.withColumn("intensity", F.col(measure) / top)
