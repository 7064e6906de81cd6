"""Registered queries: severity, projections, filters, joins and the batch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwatch.functions import labels, severity, text, times
from beatwatch.operators import correlate, enrich, geo, hotspots, joins, limits, offenders, rates, trends, violence
from beatwatch.operators.summaries import district_summary
from beatwatch.plans.registry import Tables, register

TRUTHY = "lower(trim(arrest)) IN ('true', 'yes', '1')"
CRIME_TS = "try_strptime(date, '%m/%d/%Y %I:%M:%S %p')"
ONE_RACE = """arrest_one AS (
  SELECT case_number, race FROM (
    SELECT *, row_number() OVER (PARTITION BY case_number
      ORDER BY arrest_date NULLS FIRST, cb_no NULLS FIRST, race NULLS FIRST) AS rn FROM arrests) WHERE rn = 1)"""
VIOLENCE_FLAGS = f"""flagged AS (
  SELECT *, CASE WHEN is_gunshot = 1 AND is_homicide = 0 THEN 1 ELSE 0 END AS is_non_fatal_shooting FROM (
    SELECT * EXCLUDE (month),
           coalesce(TRY_CAST(month AS INT), CAST(month({CRIME_TS}) AS INT)) AS month,
           CASE WHEN lower(victimization_primary) LIKE '%homicide%' OR lower(incident_primary) LIKE '%homicide%' THEN 1 ELSE 0 END AS is_homicide,
           CASE WHEN upper(trim(gunshot_injury)) = 'YES' THEN 1 ELSE 0 END AS is_gunshot
    FROM violence))"""
VIOLENCE_ANALYSIS = f"""{VIOLENCE_FLAGS}, analysis AS (
  SELECT month, district, CAST(sum(is_homicide) AS BIGINT) AS homicides,
         CAST(sum(is_non_fatal_shooting) AS BIGINT) AS non_fatal_shootings,
         CAST(sum(is_gunshot) AS BIGINT) AS gunshot_incidents, count(*) AS total_incidents,
         (SELECT round(sum(is_gunshot) / count(*), 4) FROM flagged) AS gunshot_proportion_overall
  FROM flagged GROUP BY month, district)"""
OFFENDER_FLAGS = """flags AS (
  SELECT concat_ws(' ', trim(first), trim(last)) AS offender_name, block, race, gender, victim_minor,
         coalesce(upper(trim(victim_minor)) = 'Y', false) AS is_victim_minor,
         CASE WHEN upper(trim(victim_minor)) = 'Y' THEN 'PRIORITY' ELSE 'STANDARD' END AS priority_flag
  FROM offenders)"""
CORRELATIONS = f"""dc AS (
  SELECT TRY_CAST(trim(district) AS INT) AS district, count(*) AS total_crimes,
         CAST(sum(CASE WHEN {TRUTHY} THEN 1 ELSE 0 END) AS BIGINT) AS total_arrests
  FROM crimes WHERE trim(district) <> '' GROUP BY 1),
dv AS (SELECT TRY_CAST(trim(district) AS INT) AS district, count(*) AS violence_incidents
       FROM violence WHERE trim(district) <> '' GROUP BY 1),
dr AS (SELECT dc.*, round(total_arrests / total_crimes, 4) AS arrest_rate, violence_incidents,
              round(violence_incidents / total_crimes, 4) AS violence_rate
       FROM dc LEFT JOIN dv ON dc.district = dv.district),
cc AS (SELECT community_area, count(*) AS total_crimes FROM crimes WHERE trim(community_area) <> '' GROUP BY 1),
corr AS (
  SELECT '{correlate.BY_DISTRICT}' AS correlation_type, CAST(district AS VARCHAR) AS group_key, CAST(NULL AS VARCHAR) AS community_area,
         total_crimes, total_arrests, arrest_rate AS metric_a, violence_incidents, violence_rate AS metric_b,
         CAST(NULL AS BIGINT) AS sex_offender_count FROM dr
  UNION ALL
  SELECT '{correlate.BY_COMMUNITY}', NULL, community_area, total_crimes, NULL, CAST(total_crimes AS DOUBLE), NULL, NULL,
         (SELECT count(*) FROM offenders) FROM cc)"""


def _tally(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


# Severity rules -----------------------------------------------------------------------------


@register(
    "sev1",
    """SELECT gunshot_injury, victimization_primary, CASE
  WHEN upper(trim(gunshot_injury)) = 'YES' THEN 4
  WHEN lower(victimization_primary) LIKE '%fatal%' OR lower(victimization_primary) LIKE '%homicide%' THEN 5
  WHEN lower(victimization_primary) LIKE '%shooting%' OR lower(victimization_primary) LIKE '%gunshot%' THEN 4
  WHEN regexp_matches(lower(victimization_primary), 'head|brain|chest') THEN 3
  WHEN regexp_matches(lower(victimization_primary), 'leg|arm') THEN 2 ELSE 1 END AS severity, count(*) AS n
FROM violence GROUP BY ALL""",
    "violence",
)
def _(t: Tables) -> DataFrame:
    rows = t.violence.withColumn("severity", severity.severity_violence("gunshot_injury", "victimization_primary"))
    return _tally(rows, "gunshot_injury", "victimization_primary", "severity")


@register(
    "sev2",
    """SELECT primary_type, CASE
  WHEN upper(primary_type) = 'HOMICIDE' THEN 5
  WHEN upper(primary_type) IN ('ASSAULT','BATTERY','ROBBERY','ARSON','KIDNAPPING','CRIMINAL SEXUAL ASSAULT','HUMAN TRAFFICKING') THEN 4
  WHEN upper(primary_type) IN ('THEFT','BURGLARY','MOTOR VEHICLE THEFT','STALKING','INTIMIDATION','SEX OFFENSE','CRIM SEXUAL ASSAULT') THEN 3
  WHEN upper(primary_type) IN ('DECEPTIVE PRACTICE','FRAUD','FORGERY','NARCOTICS','WEAPONS VIOLATION','CONCEALED CARRY LICENSE VIOLATION') THEN 2
  ELSE 1 END AS severity, count(*) AS n FROM crimes GROUP BY ALL""",
    "crimes",
)
def _(t: Tables) -> DataFrame:
    return _tally(t.crimes.withColumn("severity", severity.severity_crime("primary_type")), "primary_type", "severity")


@register(
    "sev3",
    """SELECT charge_class, CASE upper(trim(charge_class)) WHEN 'X' THEN 5 WHEN '1' THEN 4 WHEN '2' THEN 4
  WHEN '3' THEN 3 WHEN '4' THEN 3 WHEN 'A' THEN 2 ELSE 1 END AS severity, count(*) AS n FROM arrests GROUP BY ALL""",
    "arrests",
)
def _(t: Tables) -> DataFrame:
    return _tally(t.arrests.withColumn("severity", severity.severity_arrest("charge_class")), "charge_class", "severity")


@register(
    "sev4",
    """SELECT victim_minor, CASE WHEN upper(trim(victim_minor)) = 'Y' THEN 5 ELSE 3 END AS severity, count(*) AS n
FROM offenders GROUP BY ALL""",
    "offenders",
)
def _(t: Tables) -> DataFrame:
    return _tally(t.offenders.withColumn("severity", severity.severity_offender("victim_minor")), "victim_minor", "severity")


# Enrichment and filters ---------------------------------------------------------------------


@register(
    "enr1",
    """SELECT event_id, (epoch_ms(date_trunc('second', kafka_timestamp + INTERVAL 1500 MILLISECONDS))
  - epoch_ms(date_trunc('second', kafka_timestamp))) AS received_lag_ms, severity >= 3 AS is_alert,
  CASE WHEN crime_type <> '' THEN crime_type ELSE injury_type END AS event_label FROM gold""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    events = t.gold.drop("processed_at").withColumn("kafka_timestamp", F.col("kafka_timestamp").cast("timestamp"))
    now = F.col("kafka_timestamp") + F.expr("interval 1500 milliseconds")
    return enrich.enrich(events, now=now).select("event_id", "received_lag_ms", "is_alert", "event_label")


@register("flt1", "SELECT event_id, severity FROM gold WHERE severity >= 3", "gold")
def _(t: Tables) -> DataFrame:
    return enrich.alerts_only(t.gold).select("event_id", "severity")


@register(
    "flt2",
    """SELECT event_id, CASE WHEN incident_date = '' AND coalesce(district, '') = '' THEN 'missing_incident_date,missing_district'
  WHEN incident_date = '' THEN 'missing_incident_date' WHEN coalesce(district, '') = '' THEN 'missing_district' END AS invalid_reason
FROM gold""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    valid = enrich.valid_events(t.gold).select("event_id", F.lit(None).cast("string").alias("invalid_reason"))
    return valid.unionByName(enrich.malformed_events(t.gold).select("event_id", "invalid_reason"))


@register("flt3", "SELECT district, community_area, count(*) AS n FROM crimes WHERE trim(district) <> '' AND trim(community_area) <> '' GROUP BY ALL", "crimes")
def _(t: Tables) -> DataFrame:
    return _tally(enrich.filled(t.crimes, "district", "community_area"), "district", "community_area")


@register(
    "flt4",
    """SELECT case_number, TRY_CAST(latitude AS DOUBLE) AS latitude, TRY_CAST(longitude AS DOUBLE) AS longitude FROM points
WHERE TRY_CAST(latitude AS DOUBLE) IS NOT NULL AND TRY_CAST(longitude AS DOUBLE) IS NOT NULL""",
    "points",
)
def _(t: Tables) -> DataFrame:
    return enrich.with_coordinates(t.points).select("case_number", "latitude", "longitude")


# Projections --------------------------------------------------------------------------------


@register(
    "prj1",
    """SELECT event_id, coalesce(try_strptime(incident_date || ' ' || incident_time, '%m/%d/%Y %H:%M:%S'),
  try_strptime(incident_date || ' ' || incident_time, '%m/%d/%Y %H:%M'), try_strptime(incident_date, '%m/%d/%Y'),
  kafka_timestamp) AS event_time FROM gold""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return enrich.with_event_time(t.gold).select("event_id", "event_time")


@register(
    "prj2",
    f"""WITH {VIOLENCE_FLAGS} SELECT month, is_homicide, is_gunshot, is_non_fatal_shooting, count(*) AS n FROM flagged GROUP BY ALL""",
    "violence",
)
def _(t: Tables) -> DataFrame:
    return _tally(violence.violence_flags(t.violence), "month", "is_homicide", "is_gunshot", "is_non_fatal_shooting")


@register("prj3", f"WITH {OFFENDER_FLAGS} SELECT * FROM flags", "offenders")
def _(t: Tables) -> DataFrame:
    return offenders.offender_flags(t.offenders)


@register(
    "prj4",
    """SELECT district, district_name, address AS station_address, TRY_CAST(latitude AS DOUBLE) AS station_lat,
  TRY_CAST(longitude AS DOUBLE) AS station_lon FROM stations""",
    "stations",
)
def _(t: Tables) -> DataFrame:
    return offenders.station_reference(t.stations)


@register("prj5", f"WITH {CORRELATIONS} SELECT * FROM corr WHERE correlation_type = '{correlate.BY_COMMUNITY}'", "crimes violence offenders")
def _(t: Tables) -> DataFrame:
    table = correlate.correlations(t.crimes, t.violence, t.offenders)
    return table.filter(F.col("correlation_type") == correlate.BY_COMMUNITY)


@register(
    "prj6",
    """SELECT severity, source_dataset, CASE severity WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'INFO' END AS severity_label,
  CASE source_dataset WHEN 'crimes' THEN 'CRIMES' WHEN 'violence' THEN 'VIOLENCE' WHEN 'arrests' THEN 'ARRESTS' WHEN 'sex-offenders' THEN 'SEX OFFENDERS'
  ELSE coalesce(upper(source_dataset), 'UNKNOWN') END AS dataset_label, count(*) AS n FROM gold GROUP BY ALL""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    rows = t.gold.withColumns(
        {"severity_label": labels.severity_label("severity"), "dataset_label": labels.dataset_label("source_dataset")}
    )
    return _tally(rows, "severity", "source_dataset", "severity_label", "dataset_label")


@register(
    "prj7",
    """SELECT district, CASE WHEN length(ltrim(trim(district), '0')) < 3 THEN lpad(ltrim(trim(district), '0'), 3, '0')
  ELSE ltrim(trim(district), '0') END AS district_key, count(*) AS n FROM crimes GROUP BY ALL""",
    "crimes",
)
def _(t: Tables) -> DataFrame:
    return _tally(t.crimes.withColumn("district_key", text.district_key("district")), "district", "district_key")


@register(
    "prj8",
    """SELECT district, CASE WHEN avg(severity) >= 4.5 THEN 'red' WHEN avg(severity) >= 4 THEN 'orange'
  WHEN avg(severity) >= 3 THEN 'yellow' ELSE 'cyan' END AS band FROM gold WHERE district IS NOT NULL GROUP BY district""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return district_summary(t.gold).select("district", labels.severity_band("avg_severity").alias("band"))


CLUSTERED = """clustered AS (
  SELECT primary_type, CAST(latitude AS INT) % 4 AS cluster_id, CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude
  FROM points WHERE TRY_CAST(latitude AS DOUBLE) IS NOT NULL AND TRY_CAST(longitude AS DOUBLE) IS NOT NULL),
stats AS (
  SELECT cluster_id, count(*) AS crime_count, round(avg(latitude), 6) AS avg_lat, round(avg(longitude), 6) AS avg_lon,
         string_agg(DISTINCT primary_type, ', ' ORDER BY primary_type) AS primary_types FROM clustered GROUP BY cluster_id)"""


def _clustered(t: Tables) -> DataFrame:
    """Points with a cluster that follows from the data, so the statistics have a SQL check."""
    return enrich.with_coordinates(t.points).withColumn("cluster_id", F.col("latitude").cast("int") % 4)


@register("prj9", f"WITH {CLUSTERED} SELECT cluster_id, array_to_string(string_split(primary_types, ', ')[1:3], ', ') AS first_types FROM stats", "points")
def _(t: Tables) -> DataFrame:
    return hotspots.cluster_stats(_clustered(t)).select("cluster_id", text.first_items("primary_types").alias("first_types"))


@register(
    "prj10",
    """SELECT strftime(processed_at, '%H:00') AS hour_label, 'D' || district AS district_label, substr(event_id, 1, 10) AS short_id FROM gold""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return t.gold.select(
        times.hour_label("processed_at").alias("hour_label"),
        labels.district_label("district").alias("district_label"),
        text.short_id("event_id").alias("short_id"),
    )


@register(
    "prj11",
    f"""WITH r AS (SELECT primary_type, round(sum(CASE WHEN {TRUTHY} THEN 1 ELSE 0 END) / count(*), 4) AS rate,
  min(coalesce(description, location_description)) AS label FROM crimes GROUP BY 1)
SELECT primary_type, CASE WHEN rate > 0.5 THEN 'red' WHEN rate > 0.25 THEN 'yellow' ELSE 'green' END AS band, label FROM r""",
    "crimes",
)
def _(t: Tables) -> DataFrame:
    shown = labels.display_label("description", "location_description", "block")
    rows = t.crimes.groupBy("primary_type").agg(
        F.round(F.sum(text.flag(text.truthy("arrest"))) / F.count("*"), 4).alias("rate"), F.min(shown).alias("label")
    )
    return rows.select("primary_type", labels.rate_band("rate").alias("band"), "label")


# Joins --------------------------------------------------------------------------------------


@register(
    "joi1",
    f"WITH {ONE_RACE} SELECT c.case_number, c.primary_type, c.district, c.arrest, a.race FROM crimes c LEFT JOIN arrest_one a ON c.case_number = a.case_number",
    "crimes arrests",
)
def _(t: Tables) -> DataFrame:
    slim = t.crimes.select("case_number", "primary_type", "district", "arrest")
    return rates.with_race(slim, t.arrests)


@register("joi2", f"WITH {CORRELATIONS} SELECT * FROM dr", "crimes violence offenders")
def _(t: Tables) -> DataFrame:
    return correlate.district_rates(t.crimes, t.violence)


@register(
    "joi3",
    f"""WITH {CLUSTERED}, centres AS (SELECT cluster_id, min(latitude) AS centroid_lat, max(longitude) AS centroid_lon FROM clustered GROUP BY 1)
SELECT stats.*, centroid_lat, centroid_lon FROM stats JOIN centres USING (cluster_id)""",
    "points",
)
def _(t: Tables) -> DataFrame:
    rows = _clustered(t)
    centres = rows.groupBy("cluster_id").agg(F.min("latitude").alias("centroid_lat"), F.max("longitude").alias("centroid_lon"))
    return hotspots.with_centroids(hotspots.cluster_stats(rows), centres)


@register(
    "joi4",
    f"""WITH {OFFENDER_FLAGS} SELECT district, district_name, address AS station_address, TRY_CAST(latitude AS DOUBLE) AS station_lat,
  TRY_CAST(longitude AS DOUBLE) AS station_lon, (SELECT count(*) FROM flags) AS total_registered_offenders,
  (SELECT count(*) FROM flags WHERE is_victim_minor) AS minor_victim_offenders FROM stations""",
    "stations offenders",
)
def _(t: Tables) -> DataFrame:
    return offenders.offender_density(t.stations, offenders.offender_flags(t.offenders))


CENTROID_VALUES = ", ".join(f"('{k}', {lat}, {lon})" for k, (lat, lon) in geo.DISTRICT_CENTROIDS.items())


@register(
    "joi5",
    f"""SELECT g.district, c.k AS district_key, CAST(c.lat AS DOUBLE) AS centre_lat, CAST(c.lon AS DOUBLE) AS centre_lon, count(*) AS n
FROM gold g JOIN (VALUES {CENTROID_VALUES}) c(k, lat, lon) ON lpad(ltrim(trim(g.district), '0'), 3, '0') = c.k GROUP BY ALL""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return _tally(geo.locate_districts(t.gold), "district", "district_key", "centre_lat", "centre_lon")


# Batch tables -------------------------------------------------------------------------------

TRENDS = f"""trends AS (SELECT CAST(year(t) AS INT) AS year, CAST(month(t) AS INT) AS month, CAST(dayofweek(t) + 1 AS INT) AS day_of_week,
  CAST(hour(t) AS INT) AS hour, count(*) AS crime_count FROM (SELECT {CRIME_TS} AS t FROM crimes) GROUP BY 1, 2, 3, 4)"""


@register("agg1", f"WITH {TRENDS} SELECT * FROM trends", "crimes")
def _(t: Tables) -> DataFrame:
    return trends.crime_trends(t.crimes)


@register(
    "agg2",
    f"""WITH {ONE_RACE} SELECT primary_type, district, race, count(*) AS total_crimes,
  CAST(sum(CASE WHEN {TRUTHY} THEN 1 ELSE 0 END) AS BIGINT) AS total_arrests,
  round(sum(CASE WHEN {TRUTHY} THEN 1 ELSE 0 END) / count(*), 4) AS arrest_rate
FROM crimes c LEFT JOIN arrest_one a ON c.case_number = a.case_number GROUP BY 1, 2, 3""",
    "crimes arrests",
)
def _(t: Tables) -> DataFrame:
    return rates.arrest_rates(t.crimes, t.arrests)


TOP_RATES = f"""SELECT primary_type, count(*) AS total_crimes, CAST(sum(CASE WHEN {TRUTHY} THEN 1 ELSE 0 END) AS BIGINT) AS total_arrests,
  round(sum(CASE WHEN {TRUTHY} THEN 1 ELSE 0 END) / count(*), 4) AS arrest_rate
FROM crimes GROUP BY primary_type HAVING count(*) >= 100 ORDER BY arrest_rate DESC, primary_type NULLS FIRST LIMIT"""


@register("agg3", f"{TOP_RATES} 10", "crimes")
def _(t: Tables) -> DataFrame:
    return rates.top_arrest_rates(t.crimes)


@register("agg4", f"WITH {VIOLENCE_ANALYSIS} SELECT * FROM analysis", "violence")
def _(t: Tables) -> DataFrame:
    return violence.violence_analysis(t.violence)


@register("agg5", f"WITH {VIOLENCE_FLAGS} SELECT round(sum(is_gunshot) / count(*), 4) AS gunshot_proportion_overall FROM flagged", "violence")
def _(t: Tables) -> DataFrame:
    return violence.gunshot_share(violence.violence_flags(t.violence))


@register(
    "agg6",
    """SELECT community_area, count(*) AS incident_count FROM violence WHERE trim(community_area) <> '' GROUP BY 1
ORDER BY incident_count DESC, community_area LIMIT 20""",
    "violence",
)
def _(t: Tables) -> DataFrame:
    return violence.top_communities(t.violence)


@register(
    "agg7",
    f"WITH {OFFENDER_FLAGS} SELECT count(*) AS total_registered_offenders, count(*) FILTER (WHERE is_victim_minor) AS minor_victim_offenders FROM flags",
    "offenders",
)
def _(t: Tables) -> DataFrame:
    return offenders.offender_totals(offenders.offender_flags(t.offenders))


@register("agg8", f"WITH {CLUSTERED} SELECT * FROM stats", "points")
def _(t: Tables) -> DataFrame:
    return hotspots.cluster_stats(_clustered(t))


@register("agg9", f"WITH {CORRELATIONS} SELECT district, total_crimes, total_arrests, arrest_rate FROM dr", "crimes violence offenders")
def _(t: Tables) -> DataFrame:
    return correlate.district_crimes(t.crimes)


@register("agg10", f"WITH {CORRELATIONS} SELECT * FROM dv", "crimes violence offenders")
def _(t: Tables) -> DataFrame:
    return correlate.district_violence(t.violence)


@register("agg11", f"WITH {CORRELATIONS} SELECT * FROM cc", "crimes violence offenders")
def _(t: Tables) -> DataFrame:
    return correlate.community_crimes(t.crimes)


@register("agg12", f"WITH {ONE_RACE} SELECT * FROM arrest_one", "arrests")
def _(t: Tables) -> DataFrame:
    slim = t.arrests.select("case_number", "arrest_date", "cb_no", "race")
    return joins.one_per_key(slim, "case_number", ["arrest_date", "cb_no"]).select("case_number", "race")


@register("agg13", f"WITH {CORRELATIONS} SELECT * FROM corr", "crimes violence offenders")
def _(t: Tables) -> DataFrame:
    return correlate.correlations(t.crimes, t.violence, t.offenders)


@register("set1", f"WITH {CORRELATIONS} SELECT correlation_type, count(*) AS n FROM corr GROUP BY 1", "crimes violence offenders")
def _(t: Tables) -> DataFrame:
    return _tally(correlate.correlations(t.crimes, t.violence, t.offenders), "correlation_type")


@register("agg17", f"WITH {TRENDS} SELECT month, CAST(sum(crime_count) AS BIGINT) AS crime_count FROM trends GROUP BY 1", "crimes")
def _(t: Tables) -> DataFrame:
    return trends.monthly(trends.crime_trends(t.crimes))


@register("agg17y", f"WITH {TRENDS} SELECT month, CAST(sum(crime_count) AS BIGINT) AS crime_count FROM trends WHERE year = 1997 GROUP BY 1", "crimes")
def _(t: Tables) -> DataFrame:
    return trends.monthly(trends.crime_trends(t.crimes), 1997)


@register(
    "agg19",
    f"""WITH {OFFENDER_FLAGS} SELECT count(*) AS total_offenders, count(*) FILTER (WHERE is_victim_minor) AS minor_victim_count,
  count(*) FILTER (WHERE priority_flag = 'PRIORITY') AS priority_count, count(*) FILTER (WHERE priority_flag = 'STANDARD') AS standard_count FROM flags""",
    "offenders",
)
def _(t: Tables) -> DataFrame:
    return offenders.offender_summary(offenders.offender_flags(t.offenders))


RACES = "SELECT race, count(*) AS count FROM offenders WHERE race <> '' GROUP BY race ORDER BY count DESC, race LIMIT"


@register("agg20", f"{RACES} 10", "offenders")
def _(t: Tables) -> DataFrame:
    return offenders.by_race(offenders.offender_flags(t.offenders))


@register(
    "agg21",
    f"""WITH {VIOLENCE_ANALYSIS} SELECT CAST(m AS INT) AS month, CAST(coalesce(sum(homicides), 0) AS BIGINT) AS homicides,
  CAST(coalesce(sum(non_fatal_shootings), 0) AS BIGINT) AS non_fatal_shootings,
  (SELECT max(gunshot_proportion_overall) FROM analysis) AS gunshot_proportion_overall
FROM range(1, 13) r(m) LEFT JOIN analysis ON m = month GROUP BY m""",
    "violence",
)
def _(t: Tables) -> DataFrame:
    return violence.violence_by_month(violence.violence_analysis(t.violence))


@register(
    "agg22",
    f"""WITH {TRENDS}, one AS (SELECT * FROM trends WHERE year = 2001)
SELECT CAST(m AS INT) AS month, CAST(coalesce(sum(crime_count), 0) AS BIGINT) AS crime_count FROM range(1, 13) r(m) LEFT JOIN one ON m = month GROUP BY m""",
    "crimes",
)
def _(t: Tables) -> DataFrame:
    return trends.densify(trends.monthly(trends.crime_trends(t.crimes), 2001), "month", 12, ["crime_count"])


# Presentation order, cuts, caps --------------------------------------------------------------


@register("srt1", f"WITH {VIOLENCE_ANALYSIS} SELECT * REPLACE (coalesce(district, '?') AS district) FROM analysis ORDER BY month, district", "violence")
def _(t: Tables) -> DataFrame:
    return violence.ordered_violence(violence.violence_analysis(t.violence))


@register(
    "srt2",
    f"""WITH {CORRELATIONS} SELECT * FROM corr WHERE correlation_type = '{correlate.BY_COMMUNITY}'
ORDER BY total_crimes DESC NULLS LAST, group_key NULLS LAST, community_area NULLS LAST LIMIT 25""",
    "crimes violence offenders",
)
def _(t: Tables) -> DataFrame:
    return correlate.correlations_of(correlate.correlations(t.crimes, t.violence, t.offenders), "community")


@register("srt3", f"WITH {CLUSTERED} SELECT * FROM stats ORDER BY crime_count DESC, cluster_id", "points")
def _(t: Tables) -> DataFrame:
    return hotspots.ranked_hotspots(hotspots.cluster_stats(_clustered(t)))


@register("top1", f"{RACES} 3", "offenders")
def _(t: Tables) -> DataFrame:
    return offenders.by_race(offenders.offender_flags(t.offenders), 3)


@register(
    "top3",
    f"""WITH {CORRELATIONS} SELECT * FROM corr WHERE correlation_type = '{correlate.BY_DISTRICT}' AND group_key <> '' AND metric_a IS NOT NULL AND metric_b IS NOT NULL
ORDER BY total_crimes DESC, group_key LIMIT 10""",
    "crimes violence offenders",
)
def _(t: Tables) -> DataFrame:
    table = correlate.correlations(t.crimes, t.violence, t.offenders)
    return correlate.complete_correlations(correlate.of_kind(table))


@register(
    "top3b",
    f"""WITH {CORRELATIONS} SELECT community_area, metric_a AS total_crimes FROM corr WHERE community_area <> '' AND metric_a IS NOT NULL
ORDER BY metric_a DESC, community_area LIMIT 10""",
    "crimes violence offenders",
)
def _(t: Tables) -> DataFrame:
    return correlate.top_community_crimes(correlate.correlations(t.crimes, t.violence, t.offenders))


@register("top3c", f"{TOP_RATES} 8", "crimes")
def _(t: Tables) -> DataFrame:
    return rates.top_arrest_rates(t.crimes, k=8)


CAP_SQL = """WITH ranked AS (
  SELECT *, md5(CAST(o_orderkey AS VARCHAR)) AS d,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM orders)"""


@register("src10", f"{CAP_SQL} SELECT * EXCLUDE (d, rn) FROM ranked WHERE rn <= 900 ORDER BY d, o_orderkey LIMIT 2000")
def _(t: Tables) -> DataFrame:
    return limits.cap_rows(t.raw("orders"), "o_orderpriority", "o_orderkey", 900, total=2000)


@register(
    "win2",
    f"""{CAP_SQL}, one AS (SELECT l_orderkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderpriority, l_partkey FROM ranked LEFT JOIN one ON o_orderkey = l_orderkey WHERE rn <= 500""",
)
def _(t: Tables) -> DataFrame:
    capped = limits.cap_rows(t.raw("orders"), "o_orderpriority", "o_orderkey", 500)
    first = joins.one_per_key(t.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey", ["l_partkey"])
    return capped.select("o_orderkey", "o_orderpriority").join(first, "o_orderkey", "left")


# Clustering: a fit has no SQL form, but what must hold of any fit has ------------------------------

VALID_POINTS = "points WHERE TRY_CAST(latitude AS DOUBLE) IS NOT NULL AND TRY_CAST(longitude AS DOUBLE) IS NOT NULL"
K = 10


def _distances(centres: list) -> list[Column]:
    """Squared distance of a row to each of the model's centres, which stand in the plan as literals."""
    return [F.pow(F.col("latitude") - float(c[0]), 2) + F.pow(F.col("longitude") - float(c[1]), 2) for c in centres]


@register("ml1", f"SELECT count(*) AS points, CAST(0 AS BIGINT) AS misplaced, CAST({K} AS BIGINT) AS clusters FROM {VALID_POINTS}", "points")
def _(t: Tables) -> DataFrame:
    """Points, those that are nearer to another centre than to their own, and clusters that have points."""
    points = enrich.with_coordinates(t.points)
    model = hotspots.fit_hotspots(points, K)
    away = _distances(model.clusterCenters())
    own = F.element_at(F.array(*away), F.col("cluster_id") + 1)
    misplaced = F.count_if(own > F.least(*away) + 1e-9)
    return hotspots.assign_clusters(points, model).agg(F.count("*").alias("points"), misplaced.alias("misplaced"), F.countDistinct("cluster_id").alias("clusters"))


@register("ml2", f"SELECT count(*) AS points, CAST({K} AS BIGINT) AS centres, CAST(0 AS BIGINT) AS off_centre FROM {VALID_POINTS}", "points")
def _(t: Tables) -> DataFrame:
    """Centres of a fit that has settled, and those away from the mean of their members."""
    points = enrich.with_coordinates(t.points)
    model = hotspots.fit_hotspots(points, K, max_iter=500)
    means = hotspots.assign_clusters(points, model).groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
    both = means.join(hotspots.centroid_table(points, model), "cluster_id")
    # the fit ends when no centre moves by more than its tolerance; one more step moves them as little
    off = F.hypot(F.col("lat") - F.col("centroid_lat"), F.col("lon") - F.col("centroid_lon")) > 2 * hotspots.TOLERANCE
    return both.agg(F.sum("n").alias("points"), F.count("*").alias("centres"), F.count_if(off).alias("off_centre"))


@register("ml3", f"SELECT count(*) AS points, CAST({K} AS BIGINT) AS hotspots, CAST(0 AS BIGINT) AS out_of_order FROM {VALID_POINTS}", "points")
def _(t: Tables) -> DataFrame:
    """Points in the ranked hotspots, and hotspots that stand above a larger one."""
    # numbered as they come, so the order is the function's own
    ranked = hotspots.ranked_hotspots(hotspots.hotspots(t.points, K)).withColumn("place", F.monotonically_increasing_id())
    above = F.lag("crime_count").over(Window.orderBy("place"))
    return ranked.withColumn("above", above).agg(
        F.sum("crime_count").alias("points"), F.count("*").alias("hotspots"), F.count_if(F.col("above") < F.col("crime_count")).alias("out_of_order")
    )
