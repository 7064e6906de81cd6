"""Registered queries: CSV sources, normalisation, wire and JSON codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatwatch.functions import envelope, ids, text, times
from beatwatch.operators import normalise, numbering
from beatwatch.plans.registry import Tables, register
from beatwatch.schemas import RAW_COLUMNS, UNIFIED_COLUMNS, raw_schema
from beatwatch.sinks.topics import alert_messages, raw_messages
from beatwatch.sources import csv_files, topics

# rows that ``written_twice`` deals over its number of files
WRITTEN_ROWS = 1 << 22

# CSV datasets --------------------------------------------------------------------------------

AWKWARD_BLOCK = """block || ', "side" ' || chr(10) || 'lot'"""
OFFENDER_HEADERS = ", ".join(
    f'{AWKWARD_BLOCK if c == "block" else f"nullif({c}, {chr(39) * 2})"} AS "{h}"' for h, c in RAW_COLUMNS["sex-offenders"].items()
)


def _write_csv(df: DataFrame, path: str) -> str:
    """Write as the published files are: header, doubled quotes, blanks kept."""
    writer = df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _with_headers(df: DataFrame, dataset: str) -> DataFrame:
    """As published: the columns in another order and among others."""
    own = [F.col(c).alias(h) for h, c in RAW_COLUMNS[dataset].items()]
    return df.select(F.lit("7").alias("ID"), *reversed(own), F.lit("(41.8, -87.6)").alias("Location"))


def _offender_csv(t: Tables, name: str) -> tuple[str, str]:
    folder = t.work_dir("csv")
    _write_csv(_with_headers(t.offenders.withColumn("block", F.expr(AWKWARD_BLOCK.replace("chr(10)", r"'\n'"))), "sex-offenders"), f"{folder}/{name}")
    return folder, f"{folder}/{name}"


@register("src1", f"SELECT {OFFENDER_HEADERS} FROM offenders", "offenders")
def _(t: Tables) -> DataFrame:
    _, path = _offender_csv(t, "offenders.csv")
    return csv_files.read_csv(t.spark, path, raw_schema("sex-offenders"))


@register("src2", "SELECT count(*) AS n, count(last) AS with_last FROM offenders", "offenders")
def _(t: Tables) -> DataFrame:
    folder, _ = _offender_csv(t, "SEX_OFFenders_2024.csv")
    rows = csv_files.project(csv_files.find_csv(t.spark, folder, "ex_Off", "sex-offenders"), "sex-offenders")
    return rows.agg(F.count("*").alias("n"), F.count("last").alias("with_last"))


FILE_NAME = """CASE o_orderkey % 8 WHEN 0 THEN 'Violence_crimes_' WHEN 1 THEN 'CRIMES_-_' WHEN 2 THEN 'Arrests_crimes_' WHEN 3 THEN 'arrests '
  WHEN 4 THEN 'Sex_Offenders' WHEN 5 THEN 'sex offenders' WHEN 6 THEN 'Police Stations ' ELSE o_orderpriority END || CAST(o_custkey % 5 AS STRING) || '.csv'"""


@register(
    "src3",
    f"""WITH f AS (SELECT {FILE_NAME} AS file_name FROM orders),
c AS (SELECT file_name, CASE WHEN lower(file_name) LIKE '%violence%' THEN 'violence' WHEN lower(file_name) LIKE '%crimes%' THEN 'crimes'
  WHEN lower(file_name) LIKE '%arrests%' THEN 'arrests' WHEN regexp_matches(lower(file_name), 'sex[_ ]offenders') THEN 'sex-offenders'
  WHEN regexp_matches(lower(file_name), 'police[_ ]stations') THEN 'police-stations' ELSE 'unknown' END AS dataset FROM f)
SELECT file_name, dataset, count(*) AS n FROM c WHERE dataset NOT IN ('police-stations', 'unknown') GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    names = t.raw("orders").select(F.expr(FILE_NAME).alias("file_name"))
    classified = names.withColumn("dataset", csv_files.classify(F.col("file_name")))
    return csv_files.streamed_only(classified).groupBy("file_name", "dataset").agg(F.count("*").alias("n"))


@register(
    "src4",
    "SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in RAW_COLUMNS["crimes"].values()) + " FROM crimes",
    "crimes",
)
def _(t: Tables) -> DataFrame:
    path = _write_csv(_with_headers(t.crimes, "crimes"), f"{t.work_dir('csv')}/crimes.csv")
    rows = csv_files.project(csv_files.read_csv(t.spark, path, raw_schema("crimes")), "crimes")
    return csv_files.land(rows, t.work_dir("landed"))


# A station line with one field too many or too few for some suppliers.
STATION_LINE = """district || ',' || 'x' || ',' || district_name || ',' || address || CASE WHEN district = '7' THEN '' WHEN district = '9' THEN ',1,2,3' ELSE ',41.5,-87.5' END"""


@register(
    "src5",
    """SELECT CASE WHEN district IN ('7', '9') THEN 'quarantined' ELSE 'read' END AS outcome, district, count(*) AS n FROM stations GROUP BY ALL""",
    "stations",
)
def _(t: Tables) -> DataFrame:
    path = f"{t.work_dir('csv')}/stations.csv"
    # one column named like the header line; a tab as separator leaves its commas alone
    first, *rest = RAW_COLUMNS["police-stations"]
    lines = t.stations.select(F.expr(STATION_LINE).alias(",".join([first, "WEBSITE", *rest])))
    lines.write.option("header", True).option("sep", "\t").csv(path)
    raw = csv_files.read_csv(t.spark, path, raw_schema("police-stations"), keep_corrupt=True)
    raw = csv_files.land(csv_files.project(raw, "police-stations"), t.work_dir("landed"))
    good, bad = csv_files.split_corrupt(raw)
    outcome = good.select(F.lit("read").alias("outcome"), "district").unionByName(
        bad.select(F.lit("quarantined").alias("outcome"), F.split_part("record", F.lit(","), F.lit(1)).alias("district"))
    )
    return outcome.groupBy("outcome", "district").agg(F.count("*").alias("n"))


# Normalisation -------------------------------------------------------------------------------

BODY = [c for c in UNIFIED_COLUMNS if c not in ("event_id", "processed_timestamp")]
EVENT_ID = "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in BODY) + "))"


def _day_of(c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN split_part(trim({c}), ' ', 1) ELSE 'unknown' END"


def _time_of(c: str) -> str:
    return f"nullif(regexp_extract(trim({c}), '^[^ ]* +([^ ]+)', 1), '')"


def _event_sql(name: str, source: str, **fields: str) -> str:
    cols = ", ".join(
        f"CAST({fields.get(c, 'NULL')} AS {'INT' if c == 'severity' else 'BOOLEAN' if c == 'is_arrest' else 'VARCHAR'}) AS {c}"
        if c != "source_dataset"
        else f"'{name}' AS source_dataset"
        for c in BODY
    )
    return f"SELECT {EVENT_ID} AS event_id, * FROM (SELECT {cols} FROM {source})"


PLACE = "coalesce(nullif(location_description, ''), nullif(block, ''))"
SEV_VIOLENCE = """CASE WHEN upper(trim(gunshot_injury)) = 'YES' THEN 4 WHEN regexp_matches(lower(victimization_primary), 'fatal|homicide') THEN 5
  WHEN regexp_matches(lower(victimization_primary), 'shooting|gunshot') THEN 4 WHEN regexp_matches(lower(victimization_primary), 'head|brain|chest') THEN 3
  WHEN regexp_matches(lower(victimization_primary), 'leg|arm') THEN 2 ELSE 1 END"""
SEV_CRIME = """CASE upper(primary_type) WHEN 'HOMICIDE' THEN 5 WHEN 'BATTERY' THEN 4 WHEN 'ROBBERY' THEN 4 WHEN 'CRIMINAL SEXUAL ASSAULT' THEN 4
  WHEN 'THEFT' THEN 3 WHEN 'CRIM SEXUAL ASSAULT' THEN 3 WHEN 'FRAUD' THEN 2 WHEN 'NARCOTICS' THEN 2 ELSE 1 END"""
SEV_ARREST = "CASE upper(trim(charge_class)) WHEN 'X' THEN 5 WHEN '1' THEN 4 WHEN '2' THEN 4 WHEN '3' THEN 3 WHEN '4' THEN 3 WHEN 'A' THEN 2 ELSE 1 END"
EVENTS_SQL = {
    "violence": _event_sql(
        "violence",
        "violence",
        victim_id="nullif(case_number, '')",
        incident_date=_day_of("date"),
        incident_time=f"coalesce({_time_of('date')}, CASE WHEN length(trim(hour)) < 2 THEN lpad(trim(hour), 2, '0') ELSE trim(hour) END || ':00')",
        location=PLACE,
        district="nullif(district, '')",
        beat="nullif(beat, '')",
        crime_type="coalesce(nullif(victimization_primary, ''), nullif(incident_primary, ''))",
        injury_type="nullif(victimization_primary, '')",
        severity=SEV_VIOLENCE,
        latitude="latitude",
        longitude="longitude",
    ),
    "crimes": _event_sql(
        "crimes",
        "crimes",
        victim_id="nullif(case_number, '')",
        incident_date=_day_of("date"),
        incident_time=_time_of("date"),
        location=PLACE,
        district="nullif(district, '')",
        beat="nullif(beat, '')",
        crime_type="nullif(primary_type, '')",
        injury_type="nullif(description, '')",
        severity=SEV_CRIME,
        latitude="nullif(latitude, '')",
        longitude="nullif(longitude, '')",
        is_arrest="lower(trim(arrest)) IN ('true', 'yes', '1')",
    ),
    "arrests": _event_sql(
        "arrests",
        "arrests",
        victim_id="coalesce(cb_no, case_number)",
        incident_date=_day_of("arrest_date"),
        incident_time=_time_of("arrest_date"),
        crime_type="coalesce(nullif(charge_description, ''), nullif(charges_description, ''))",
        injury_type="charge_type",
        severity=SEV_ARREST,
        is_arrest="true",
    ),
    "offenders": _event_sql(
        "sex-offenders",
        "offenders",
        victim_id="CASE WHEN first IS NULL THEN last ELSE trim(last) || ' ' || trim(first) END",
        incident_date="coalesce(birth_date, 'unknown')",
        location="block",
        crime_type="'SEX OFFENDER REGISTRATION'",
        injury_type="'VICTIM_MINOR:' || trim(victim_minor)",
        severity="CASE WHEN upper(trim(victim_minor)) = 'Y' THEN 5 ELSE 3 END",
    ),
}
ALL_EVENTS = "\nUNION ALL\n".join(EVENTS_SQL.values())


def _timeless(events: DataFrame) -> DataFrame:
    return events.drop("processed_timestamp")


@register("nrm1", EVENTS_SQL["violence"], "violence")
def _(t: Tables) -> DataFrame:
    return _timeless(normalise.violence_events(t.violence))


@register("nrm2", EVENTS_SQL["crimes"], "crimes")
def _(t: Tables) -> DataFrame:
    return _timeless(normalise.crime_events(t.crimes))


@register("nrm3", EVENTS_SQL["arrests"], "arrests")
def _(t: Tables) -> DataFrame:
    return _timeless(normalise.arrest_events(t.arrests))


@register("nrm4", EVENTS_SQL["offenders"], "offenders")
def _(t: Tables) -> DataFrame:
    return _timeless(normalise.offender_events(t.offenders))


@register(
    "nrm5",
    f"""SELECT source_dataset, district, severity, is_arrest, count(*) AS n, count(victim_id) AS victims,
  CAST(sum(CAST('0x' || substr(event_id, 1, 8) AS BIGINT)) AS BIGINT) AS id_sum FROM ({ALL_EVENTS}) GROUP BY ALL""",
    "violence crimes arrests offenders",
)
def _(t: Tables) -> DataFrame:
    """All four datasets as one event stream; ids hash whole events, so their sum checks every field."""
    number = F.conv(F.substring("event_id", 1, 8), 16, 10).cast("bigint")
    return normalise.unify(t.raw_sets).groupBy("source_dataset", "district", "severity", "is_arrest").agg(
        F.count("*").alias("n"), F.count("victim_id").alias("victims"), F.sum(number).alias("id_sum")
    )


@register("nrm6", f"SELECT date, {_day_of('date')} AS incident_date, {_time_of('date')} AS incident_time, count(*) AS n FROM violence GROUP BY ALL", "violence")
def _(t: Tables) -> DataFrame:
    parts = t.violence.select("date", times.split_date("date").alias("incident_date"), times.split_time("date").alias("incident_time"))
    return parts.groupBy(*parts.columns).agg(F.count("*").alias("n"))


@register(
    "nrm6b",
    "SELECT date, strftime(try_strptime(date, '%m/%d/%Y %I:%M:%S %p'), '%H:%M:%S') AS incident_time, count(*) AS n FROM violence GROUP BY ALL",
    "violence",
)
def _(t: Tables) -> DataFrame:
    parts = t.violence.select("date", times.split_time("date", clock="24h").alias("incident_time"))
    return parts.groupBy(*parts.columns).agg(F.count("*").alias("n"))


@register("nrm7", "SELECT nullif(location_description, '') AS location_description, count(*) AS n FROM crimes GROUP BY 1", "crimes")
def _(t: Tables) -> DataFrame:
    cleaned = t.crimes.select(text.null_if_empty("location_description").alias("location_description"))
    return cleaned.groupBy("location_description").agg(F.count("*").alias("n"))


@register(
    "nrm8",
    """SELECT count(*) AS n, count(DISTINCT event_id) AS content_ids, count(*) AS random_ids, 64 AS content_length, 36 AS random_length FROM gold""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    marked = t.gold.select(ids.content_id("event_id", "victim_id").alias("c"), ids.random_id().alias("r"))
    return marked.agg(
        F.count("*").alias("n"),
        F.countDistinct("c").alias("content_ids"),
        F.countDistinct("r").alias("random_ids"),
        F.max(F.length("c")).alias("content_length"),
        F.max(F.length("r")).alias("random_length"),
    )


def written_twice(t: Tables, rows: DataFrame, files: int) -> DataFrame:
    """A table in which every row stands twice, read from at least ``files`` files; no row is shuffled to be written.

    What can be told from a row, such as its id, is left to the reader: it takes less to compute than to store.
    """
    path = t.work_dir("rows")
    most = max(1, min(2 * rows.count(), WRITTEN_ROWS) // files)
    doubled = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy")).drop("_copy")
    doubled.write.option("maxRecordsPerFile", most).option("compression", "zstd").parquet(path)
    return t.spark.read.parquet(path)


def _doubled_arrests(t: Tables, files: int) -> DataFrame:
    return numbering.unique_ids(normalise.arrest_events(written_twice(t, t.arrests, files)))


@register("nrm8b", "SELECT 2 * count(*) AS n, 2 * count(*) AS ids, 2 * count(*) AS same_again FROM arrests", "arrests")
def _(t: Tables) -> DataFrame:
    """Unique ids of a table in which every row stands twice, and how many of them a second run in other files repeats.

    The ids of both runs meet once, as bytes; text that is no hex is no id and counts for nothing.
    """
    runs = [_doubled_arrests(t, files).select(F.unhex("event_id").alias("id"), F.lit(run).alias("run")) for run, files in enumerate((3, 5))]
    in_run = [F.count_if(F.col("run") == run).alias(f"in_{run}") for run in (0, 1)]
    met = runs[0].unionAll(runs[1]).groupBy("id").agg(*in_run)
    known = F.col("id").isNotNull() & (F.col("in_0") > 0)
    return met.agg(
        F.sum("in_0").alias("n"),
        F.count_if(known).alias("ids"),
        F.coalesce(F.sum(F.when(known, F.col("in_1"))), F.lit(0)).alias("same_again"),
    )


@register(
    "nrm8c",
    f"""WITH doubled AS (SELECT event_id, row_number() OVER (PARTITION BY event_id) - 1 AS k FROM (({EVENTS_SQL['arrests']}) UNION ALL ({EVENTS_SQL['arrests']})))
SELECT CASE WHEN k = 0 THEN event_id ELSE sha256(event_id || chr(31) || k) END AS event_id FROM doubled""",
    "arrests",
)
def _(t: Tables) -> DataFrame:
    return _doubled_arrests(t, 4).select("event_id")


@register("nrm9", "SELECT arrest, lower(trim(arrest)) IN ('true', 'yes', '1') AS arrested, count(*) AS n FROM crimes GROUP BY ALL", "crimes")
def _(t: Tables) -> DataFrame:
    return t.crimes.groupBy("arrest", text.truthy("arrest").alias("arrested")).agg(F.count("*").alias("n"))


# Wire and JSON codecs ------------------------------------------------------------------------


def wire(t: Tables) -> DataFrame:
    """Enriched events as wire messages with an ingest time."""
    return raw_messages(t.gold, 258, keep=[F.col("kafka_timestamp").cast("timestamp").alias("timestamp")])


@register("nrm10", "SELECT event_id AS key, '0000000102' AS header, '{' AS body_start FROM gold", "gold")
def _(t: Tables) -> DataFrame:
    value = F.col("value")
    return wire(t).select(
        "key",
        F.hex(F.substring(value, 1, 5)).alias("header"),
        F.substring(envelope.strip_header(value).cast("string"), 1, 1).alias("body_start"),
    )


GOLD_EVENT = ", ".join(UNIFIED_COLUMNS)


@register("src7", f"SELECT kafka_timestamp, {GOLD_EVENT} FROM gold", "gold")
def _(t: Tables) -> DataFrame:
    return topics.decode_events(wire(t))


@register("udf1", "SELECT event_type, CASE WHEN length(event_type) > 5 THEN substr(event_type, 6) ELSE event_type END AS payload, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    payload = envelope.strip_header(F.col("event_type").cast("binary")).cast("string")
    return t.raw("events").groupBy("event_type", payload.alias("payload")).agg(F.count("*").alias("n"))


JSON_COLS = ", ".join(f"trim({c}) AS {c}" for c in normalise.JSON_REQUIRED)
JSON_OK = " AND ".join(f"coalesce(trim({c}), '') <> ''" for c in normalise.JSON_REQUIRED)


@register("nrm11", f"SELECT {JSON_COLS}, true AS accepted FROM crimes WHERE {JSON_OK} UNION ALL SELECT {', '.join(['NULL'] * 8)}, false FROM crimes WHERE NOT ({JSON_OK})", "crimes")
def _(t: Tables) -> DataFrame:
    fields = normalise.JSON_REQUIRED
    schema = ", ".join(f"{c} string" for c in fields)
    messages = normalise.json_messages(t.crimes).withColumn("v", F.from_json("value", schema))
    return messages.select(*[F.col(f"v.{c}").alias(c) for c in fields], "accepted")


@register(
    "src8",
    f"""SELECT {GOLD_EVENT}, CASE WHEN crime_type <> '' THEN crime_type ELSE injury_type END AS event_label,
  epoch_us(processed_at) // 1000 AS processed_timestamp_api FROM gold WHERE severity >= 3 AND CAST(event_id AS BIGINT) % 29 <> 0""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    from beatwatch.functions.labels import event_label

    enriched = t.gold.filter("severity >= 3").withColumn("event_label", event_label("crime_type", "injury_type"))
    messages = alert_messages(enriched)
    # some messages arrive cut off; the reader skips them
    broken = messages.withColumn(
        "value", F.when(F.col("key").cast("bigint") % 29 == 0, F.substring("value", 1, 40)).otherwise(F.col("value"))
    )
    return topics.parse_alerts(broken.select("value"))
