"""District and community rates side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatwatch.functions.text import district_number, truthy
from beatwatch.operators.enrich import filled
from beatwatch.operators.rates import flag_rate, ratio
from beatwatch.schemas import TABLES

# The correlation types.
BY_DISTRICT = "violence_rate_vs_arrest_rate_by_district"
BY_COMMUNITY = "sex_offender_density_vs_crime_rate_by_community"


def district_crimes(crimes: DataFrame) -> DataFrame:
    """Totals per integer district, so '11' and '011' meet; text that is no number groups as null."""
    keyed = filled(crimes, "district").select(district_number("district").alias("district"), "arrest")
    return flag_rate(keyed, ["district"], truthy("arrest"))


def district_violence(violence: DataFrame) -> DataFrame:
    keyed = filled(violence, "district").select(district_number("district").alias("district"))
    return keyed.groupBy("district").agg(F.count("*").alias("violence_incidents"))


def community_crimes(crimes: DataFrame) -> DataFrame:
    return filled(crimes, "community_area").groupBy("community_area").agg(F.count("*").alias("total_crimes"))


def district_rates(crimes: DataFrame, violence: DataFrame) -> DataFrame:
    """District crimes left-joined with district violence; both sides are already one row per district."""
    joined = district_crimes(crimes).join(district_violence(violence), "district", "left")
    return joined.withColumn("violence_rate", ratio("violence_incidents", "total_crimes"))


def _aligned(df: DataFrame, **given) -> DataFrame:
    """The correlations shape; columns not given are typed nulls."""
    return df.select(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["correlations"]]
    )


def correlations(crimes: DataFrame, violence: DataFrame, offenders: DataFrame) -> DataFrame:
    by_district = _aligned(
        district_rates(crimes, violence),
        correlation_type=F.lit(BY_DISTRICT),
        group_key=F.col("district"),
        total_crimes=F.col("total_crimes"),
        total_arrests=F.col("total_arrests"),
        metric_a=F.col("arrest_rate"),
        violence_incidents=F.col("violence_incidents"),
        metric_b=F.col("violence_rate"),
    )
    by_community = _aligned(
        community_crimes(crimes),
        correlation_type=F.lit(BY_COMMUNITY),
        community_area=F.col("community_area"),
        total_crimes=F.col("total_crimes"),
        metric_a=F.col("total_crimes"),
        sex_offender_count=offenders.agg(F.count("*").alias("n")).scalar(),
    )
    return by_district.unionByName(by_community)


def of_kind(table: DataFrame, kind: str = "district") -> DataFrame:
    """All groups of one correlation type; anything but 'community' means district."""
    return table.filter(F.col("correlation_type") == (BY_COMMUNITY if kind == "community" else BY_DISTRICT))


def correlations_of(table: DataFrame, kind: str = "district", k: int = 25) -> DataFrame:
    """The page of the largest groups of one correlation type."""
    return of_kind(table, kind).orderBy(
        F.desc_nulls_last("total_crimes"), F.asc_nulls_last("group_key"), F.asc_nulls_last("community_area")
    ).limit(k)


def complete_correlations(rows: DataFrame, k: int = 10) -> DataFrame:
    """Largest groups that have a key and both metrics."""
    whole = rows.filter((F.col("group_key") != "") & F.col("metric_a").isNotNull() & F.col("metric_b").isNotNull())
    return whole.orderBy(F.desc_nulls_last("total_crimes"), F.asc("group_key")).limit(k)


def top_community_crimes(rows: DataFrame, k: int = 10) -> DataFrame:
    known = rows.filter((F.col("community_area") != "") & F.col("metric_a").isNotNull())
    ranked = known.select("community_area", F.col("metric_a").alias("total_crimes"))
    return ranked.orderBy(F.desc("total_crimes"), F.asc("community_area")).limit(k)
