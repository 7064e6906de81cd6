"""Enrichment, routing filters and validity of unified events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwatch.functions.labels import event_label
from beatwatch.functions.severity import ALERT_FROM
from beatwatch.functions.text import is_present
from beatwatch.functions.times import event_time, lag_ms


def enrich(events: DataFrame, received: str = "kafka_timestamp", now: Column | None = None, exact_lag: bool = False) -> DataFrame:
    """Add processed_at, received_lag_ms, is_alert and event_label."""
    staged = events.withColumn("processed_at", now if now is not None else F.current_timestamp())
    return staged.withColumns(
        {
            "received_lag_ms": lag_ms("processed_at", received, exact_lag),
            "is_alert": F.col("severity") >= ALERT_FROM,
            "event_label": event_label("crime_type", "injury_type"),
        }
    )


def alerts_only(events: DataFrame, severity: str = "severity", at_least: int = ALERT_FROM) -> DataFrame:
    return events.filter(F.col(severity) >= at_least)


# Fields an event needs to be counted by place and time.
REQUIRED = ("incident_date", "district")


def valid_events(events: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Events whose required fields are neither null nor empty. Plain comparisons, so the scan can use them."""
    return events.filter(reduce(lambda a, b: a & b, [F.col(c) != "" for c in required]))


def malformed_events(events: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The other events, each with ``invalid_reason`` naming the missing fields."""
    reason = F.concat_ws(",", *[F.when(~is_present(c), F.lit(f"missing_{c}")) for c in required])
    return events.withColumn("invalid_reason", reason).filter(F.col("invalid_reason") != "")


def filled(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key columns all hold non-blank text."""
    return df.filter(reduce(lambda a, b: a & b, [F.trim(F.col(k)) != "" for k in keys]))


def with_event_time(events: DataFrame, ingested: str = "kafka_timestamp") -> DataFrame:
    return events.withColumn("event_time", event_time("incident_date", "incident_time", ingested))


def with_coordinates(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Cast coordinates to double; rows where either is blank or malformed are left out."""
    cast = df.withColumns({lat: F.col(lat).try_cast("double"), lon: F.col(lon).try_cast("double")})
    return cast.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
