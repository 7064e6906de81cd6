"""Violence and gunshot analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwatch.functions.text import flag
from beatwatch.functions.times import parse_time
from beatwatch.operators.enrich import filled
from beatwatch.operators.trends import densify


def violence_flags(df: DataFrame) -> DataFrame:
    """Month and the homicide, gunshot and non-fatal-shooting flags (0/1, null text is 0)."""
    homicide = F.contains(F.lower("victimization_primary"), F.lit("homicide")) | F.contains(
        F.lower("incident_primary"), F.lit("homicide")
    )
    return df.withColumns(
        {
            "month": F.coalesce(F.col("month").try_cast("int"), F.month(parse_time("date"))),
            "is_homicide": flag(homicide),
            "is_gunshot": flag(F.upper(F.trim("gunshot_injury")) == "YES"),
        }
    ).withColumn("is_non_fatal_shooting", flag((F.col("is_gunshot") == 1) & (F.col("is_homicide") == 0)))


def share(total: Column | str, part: Column | str) -> Column:
    """Half-up share to 4 digits, 0.0 when there is nothing to share."""
    total = F.col(total) if isinstance(total, str) else total
    part = F.col(part) if isinstance(part, str) else part
    return F.when(total > 0, F.round(part / total, 4)).otherwise(F.lit(0.0))


def gunshot_share(flagged: DataFrame) -> DataFrame:
    totals = flagged.agg(F.count("*").alias("total"), F.coalesce(F.sum("is_gunshot"), F.lit(0)).alias("gunshots"))
    return totals.select(share("total", "gunshots").alias("gunshot_proportion_overall"))


def violence_analysis(violence: DataFrame) -> DataFrame:
    """Counts by month and district, each with the overall gunshot share.

    The share is a scalar subquery: its scan reads the gunshot column alone.
    """
    flagged = violence_flags(violence)
    monthly = (
        flagged.groupBy("month", "district")
        .agg(
            F.sum("is_homicide").alias("homicides"),
            F.sum("is_non_fatal_shooting").alias("non_fatal_shootings"),
            F.sum("is_gunshot").alias("gunshot_incidents"),
            F.count("*").alias("total_incidents"),
        )
    )
    return monthly.withColumn("gunshot_proportion_overall", gunshot_share(flagged).scalar())


def top_communities(violence: DataFrame, k: int = 20, key: str = "community_area", count: str = "incident_count") -> DataFrame:
    counts = filled(violence, key).groupBy(key).agg(F.count("*").alias(count))
    return counts.orderBy(F.desc(count), F.asc(key)).limit(k)


def violence_by_month(analysis: DataFrame) -> DataFrame:
    """Twelve months of homicides and non-fatal shootings over all districts, with the overall share."""
    dense = densify(analysis, "month", 12, ["homicides", "non_fatal_shootings"])
    overall = analysis.agg(F.coalesce(F.max("gunshot_proportion_overall"), F.lit(0.0)).alias("s"))
    return dense.withColumn("gunshot_proportion_overall", overall.scalar())


def ordered_violence(analysis: DataFrame) -> DataFrame:
    """Presentation order by month and district; a missing district shows as '?'."""
    return analysis.orderBy("month", "district").withColumn("district", F.coalesce("district", F.lit("?")))
