"""The given tables in the shape of the public-safety datasets.

Each shape is one SELECT that Spark and DuckDB both understand, so the operators and their SQL
checks start from the same rows. Remainders of keys place the awkward values every operator must
handle: nulls, blanks, malformed dates and numbers, mixed case, repeated keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = {
    "crimes": "orders",
    "arrests": "lineitem",
    "violence": "lineitem",
    "offenders": "customer",
    "stations": "supplier",
    "gold": "events",
    "points": "part",
}


def _two(number: str) -> str:
    return f"lpad(CAST({number} AS STRING), 2, '0')"


def _day(ts: str) -> str:
    return f"{_two(f'month({ts})')} || '/' || {_two(f'day({ts})')} || '/' || CAST(year({ts}) AS STRING)"


def _stamp(ts: str, hour: str, minute: str, second: str) -> str:
    """'MM/dd/yyyy hh:mm:ss AM|PM' from a date column and hour 0-23, minute, second."""
    twelve = f"CASE WHEN ({hour}) % 12 = 0 THEN 12 ELSE ({hour}) % 12 END"
    return (
        f"{_day(ts)} || ' ' || {_two(twelve)} || ':' || {_two(minute)} || ':' || {_two(second)}"
        f" || CASE WHEN {hour} < 12 THEN ' AM' ELSE ' PM' END"
    )


def _pick(number: str, values: list[str | None]) -> str:
    cases = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)
    )
    return f"CASE {number} {cases} END"


_CRIME_TYPES = [
    "HOMICIDE",
    "BATTERY",
    "THEFT",
    "FRAUD",
    "NARCOTICS",
    "Robbery",
    "CRIM SEXUAL ASSAULT",
    "CRIMINAL SEXUAL ASSAULT",
    " ARSON",
    "OTHER OFFENSE",
    "",
    None,
]
_VICTIM_TYPES = [
    "HOMICIDE",
    "NON-FATAL SHOOTING",
    "FATALITY",
    "Head wound",
    "LEG INJURY",
    "BATTERY",
    "",
    None,
]

SHAPES = {
    "crimes": f"""
SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN '' ELSE 'HZ' || CAST(o_orderkey AS STRING) END AS case_number,
       CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN 'not a date'
            WHEN o_orderkey % 107 = 0 THEN {_day("o_orderdate")}
            ELSE {_stamp("o_orderdate", "o_orderkey % 24", "o_custkey % 60", "o_orderkey % 60")} END AS date,
       CASE WHEN o_custkey % 13 = 0 THEN '' ELSE 'BLOCK ' || CAST(o_custkey % 100 AS STRING) END AS block,
       {_pick("(o_orderkey + o_custkey) % 12", _CRIME_TYPES)} AS primary_type,
       o_orderpriority AS description,
       CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'PLACE ' || o_orderstatus END AS location_description,
       CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'true' WHEN o_orderstatus = 'P' THEN ' Yes ' ELSE 'false' END AS arrest,
       CAST(o_custkey % 300 AS STRING) AS beat,
       CASE WHEN o_custkey % 29 = 0 THEN NULL WHEN o_custkey % 31 = 0 THEN '  ' WHEN o_custkey % 37 = 0 THEN 'N/A'
            ELSE CAST(o_custkey % 25 + 1 AS STRING) END AS district,
       CASE WHEN o_custkey % 43 = 0 THEN NULL WHEN o_custkey % 47 = 0 THEN ' ' ELSE CAST(o_custkey % 77 AS STRING) END AS community_area,
       CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN 'bad'
            ELSE '41.' || lpad(CAST(600 + o_orderkey * 7 % 400 AS STRING), 3, '0') END AS latitude,
       CASE WHEN o_orderkey % 61 = 0 THEN '' ELSE '-87.' || lpad(CAST(500 + o_custkey * 3 % 300 AS STRING), 3, '0') END AS longitude
FROM orders""",
    "arrests": f"""
SELECT CASE WHEN (l_orderkey + l_linenumber) % 17 = 0 THEN NULL ELSE 'CB' || CAST(l_orderkey * 10 + l_linenumber AS STRING) END AS cb_no,
       'HZ' || CAST(l_orderkey AS STRING) AS case_number,
       CASE WHEN l_partkey % 67 = 0 THEN NULL ELSE {_stamp("l_shipdate", "l_partkey % 24", "l_suppkey % 60", "l_orderkey % 60")} END AS arrest_date,
       {_pick("(l_partkey + l_linenumber) % 7", ["BLACK", "WHITE", "WHITE HISPANIC", "ASIAN", " ", "", None])} AS race,
       CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'CHARGE ' || l_returnflag END AS charge_description,
       l_linestatus AS charge_type,
       {_pick("l_linenumber", [None, "X", " x ", "1", "2", "3", "A", "Z"])} AS charge_class,
       CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'CHARGES ' || l_linestatus END AS charges_description
FROM lineitem""",
    "violence": f"""
SELECT 'JG' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS case_number,
       CASE WHEN l_orderkey % 71 = 0 THEN '' WHEN l_orderkey % 73 = 0 THEN {_day("l_shipdate")}
            ELSE {_stamp("l_shipdate", "l_orderkey % 24", "l_partkey % 60", "l_suppkey % 60")} END AS date,
       CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE CAST(l_orderkey % 24 AS STRING) END AS hour,
       CASE WHEN l_partkey % 9 = 0 THEN NULL WHEN l_partkey % 23 = 0 THEN 'n/a' ELSE CAST(month(l_shipdate) AS STRING) END AS month,
       'BLOCK ' || CAST(l_suppkey AS STRING) AS block,
       CASE WHEN l_partkey % 29 = 0 THEN NULL WHEN l_partkey % 31 = 0 THEN '' ELSE lpad(CAST(l_partkey % 22 + 1 AS STRING), 3, '0') END AS district,
       CAST(l_suppkey % 90 AS STRING) AS beat,
       CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN '  ' ELSE 'AREA ' || CAST(l_partkey % 77 AS STRING) END AS community_area,
       CASE WHEN l_suppkey % 4 = 0 THEN '' ELSE 'STREET' END AS location_description,
       {_pick("l_partkey % 8", _VICTIM_TYPES)} AS victimization_primary,
       {_pick("l_suppkey % 4", ["HOMICIDE", "SHOOTING", "", None])} AS incident_primary,
       CASE l_returnflag WHEN 'A' THEN 'YES' WHEN 'N' THEN 'NO' ELSE CASE WHEN l_linenumber % 2 = 0 THEN ' yes ' ELSE NULL END END AS gunshot_injury,
       '41.' || lpad(CAST(600 + l_partkey % 400 AS STRING), 3, '0') AS latitude,
       '-87.' || lpad(CAST(500 + l_suppkey % 300 AS STRING), 3, '0') AS longitude
FROM lineitem""",
    "offenders": f"""
SELECT CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE ' LAST' || CAST(c_custkey AS STRING) END AS last,
       CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_name || ' ' END AS first,
       'BLOCK ' || CAST(c_nationkey AS STRING) AS block,
       CASE WHEN c_custkey % 2 = 0 THEN 'MALE' ELSE 'FEMALE' END AS gender,
       CASE WHEN c_custkey % 29 = 0 THEN '' WHEN c_custkey % 31 = 0 THEN NULL ELSE c_mktsegment END AS race,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE {_two("c_nationkey % 12 + 1")} || '/15/' || CAST(1950 + c_custkey % 50 AS STRING) END AS birth_date,
       CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_acctbal < 0 THEN 'Y' WHEN c_custkey % 41 = 0 THEN ' y ' ELSE 'N' END AS victim_minor
FROM customer""",
    "stations": """
SELECT CAST(s_suppkey % 25 + 1 AS STRING) AS district, s_name AS district_name, 'ADDRESS ' || CAST(s_nationkey AS STRING) AS address,
       CASE WHEN s_suppkey % 9 = 0 THEN 'unknown' ELSE '41.' || CAST(600 + s_suppkey % 400 AS STRING) END AS latitude,
       CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE '-87.' || CAST(500 + s_nationkey AS STRING) END AS longitude
FROM supplier""",
    "gold": f"""
SELECT CAST(event_id AS STRING) AS event_id,
       CASE event_type WHEN 'signup' THEN 'crimes' WHEN 'purchase' THEN 'violence' WHEN 'error' THEN 'arrests' WHEN 'view' THEN 'sex-offenders' ELSE NULL END AS source_dataset,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'V' || CAST(user_id AS STRING) END AS victim_id,
       CASE WHEN event_id % 83 = 0 THEN '' WHEN event_id % 79 = 0 THEN 'unknown' ELSE {_day("ts")} END AS incident_date,
       CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN {_two("hour(ts)")} || ':00'
            ELSE {_two("hour(ts)")} || ':' || {_two("minute(ts)")} || ':' || {_two("second(ts)")} END AS incident_time,
       'PLACE ' || CAST(user_id % 9 AS STRING) AS location,
       CASE WHEN user_id % 29 = 0 THEN NULL WHEN user_id % 31 = 0 THEN '' ELSE lpad(CAST(user_id % 25 + 1 AS STRING), 3, '0') END AS district,
       CAST(user_id AS STRING) AS beat,
       CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 11 = 0 THEN NULL ELSE 'TYPE ' || event_type END AS crime_type,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'INJURY ' || CAST(user_id % 4 AS STRING) END AS injury_type,
       CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST((event_id * 7 + user_id) % 5 + 1 AS INT) END AS severity,
       '41.' || CAST(600 + user_id AS STRING) AS latitude,
       '-87.' || CAST(500 + user_id AS STRING) AS longitude,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 3 = 1 END AS is_arrest,
       CAST(1704067200000 + event_id AS BIGINT) AS processed_timestamp,
       ts AS kafka_timestamp,
       ts AS processed_at,
       value
FROM events""",
    "points": """
SELECT CAST(p_partkey AS STRING) AS case_number, p_type AS primary_type,
       CASE WHEN p_partkey % 53 = 0 THEN 'bad' ELSE CAST(p_size AS STRING) END AS latitude,
       CASE WHEN p_partkey % 59 = 0 THEN NULL ELSE CAST(CAST(floor(p_retailprice) AS INT) AS STRING) END AS longitude
FROM part""",
}


def shape(spark: SparkSession, sf_dir: str, name: str, source: DataFrame | None = None) -> DataFrame:
    """A shaped dataset over the whole given table, or over a (streaming) frame of that table."""
    table = SOURCES[name]
    rows = source if source is not None else spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
    head, _, tail = SHAPES[name].rpartition(f"FROM {table}")
    return spark.sql(f"{head}FROM {{{table}}}{tail}", **{table: rows})


def shape_sql(*names: str) -> str:
    """WITH clause that defines the shapes for a SQL check."""
    return "WITH " + ",\n".join(f"{n} AS ({SHAPES[n].strip()})" for n in names)
