"""Offender registry: priority flags, totals, density per station."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def offender_flags(offenders: DataFrame) -> DataFrame:
    minor = F.coalesce(F.upper(F.trim("victim_minor")) == "Y", F.lit(False))
    return offenders.select(
        F.concat_ws(" ", F.trim("first"), F.trim("last")).alias("offender_name"),
        "block",
        "race",
        "gender",
        "victim_minor",
        minor.alias("is_victim_minor"),
        F.when(minor, F.lit("PRIORITY")).otherwise(F.lit("STANDARD")).alias("priority_flag"),
    )


def offender_totals(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count("*").alias("total_registered_offenders"),
        F.count_if(F.col("is_victim_minor")).alias("minor_victim_offenders"),
    )


def station_reference(stations: DataFrame) -> DataFrame:
    return stations.select(
        "district",
        "district_name",
        F.col("address").alias("station_address"),
        F.col("latitude").try_cast("double").alias("station_lat"),
        F.col("longitude").try_cast("double").alias("station_lon"),
    )


def offender_density(stations: DataFrame, flagged: DataFrame) -> DataFrame:
    """Every station with the city-wide totals: one scalar subquery, no join."""
    totals = offender_totals(flagged).select(F.struct("*").alias("t"))
    return (
        station_reference(stations)
        .withColumn("_t", totals.scalar())
        .select(
            "*",
            F.col("_t.total_registered_offenders").alias("total_registered_offenders"),
            F.col("_t.minor_victim_offenders").alias("minor_victim_offenders"),
        )
        .drop("_t")
    )


def offender_summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(
        F.count("*").alias("total_offenders"),
        F.count_if(F.col("is_victim_minor")).alias("minor_victim_count"),
        F.count_if(F.col("priority_flag") == "PRIORITY").alias("priority_count"),
        F.count_if(F.col("priority_flag") == "STANDARD").alias("standard_count"),
    )


def by_race(flagged: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent races; empty text is left out, blanks are kept."""
    counts = flagged.filter(F.col("race") != "").groupBy("race").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("race")).limit(k)
