"""Counts with a flag rate per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwatch.functions.text import flag, truthy
from beatwatch.operators.joins import one_per_key, left_join_one


def ratio(part: Column | str, whole: Column | str, digits: int = 4) -> Column:
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.round(part / whole, digits)


def flag_rate(
    df: DataFrame,
    keys: list[str],
    is_flagged: Column,
    total: str = "total_crimes",
    flagged: str = "total_arrests",
    rate: str = "arrest_rate",
) -> DataFrame:
    """count, sum of flags and their ratio (4 digits) per group; nulls form a group."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(total), F.sum(flag(is_flagged)).alias(flagged))
    return counts.withColumn(rate, ratio(flagged, total))


def with_race(crimes: DataFrame, arrests: DataFrame) -> DataFrame:
    """Every crime row with the race of its case's arrest, where there is one."""
    races = one_per_key(arrests.select("case_number", "arrest_date", "cb_no", "race"), "case_number", ["arrest_date", "cb_no"])
    return left_join_one(crimes, races.select("case_number", "race"), "case_number")


def arrest_rates(crimes: DataFrame, arrests: DataFrame) -> DataFrame:
    """Arrest rate by crime type, district and race."""
    slim = crimes.select("case_number", "primary_type", "district", "arrest")
    return flag_rate(with_race(slim, arrests), ["primary_type", "district", "race"], truthy("arrest"))


def top_arrest_rates(crimes: DataFrame, at_least: int = 100, k: int = 10) -> DataFrame:
    """Crime types with the highest arrest rate among those with enough crimes."""
    rates = flag_rate(crimes, ["primary_type"], truthy("arrest"))
    return rates.filter(F.col("total_crimes") >= at_least).orderBy(F.desc("arrest_rate"), F.asc("primary_type")).limit(k)
