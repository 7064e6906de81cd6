"""Column contracts: raw datasets, the unified event, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


# Header name in the published CSV -> our column name. All text at ingest.
RAW_COLUMNS: dict[str, dict[str, str]] = {
    "crimes": {
        "Case Number": "case_number",
        "Date": "date",
        "Block": "block",
        "Primary Type": "primary_type",
        "Description": "description",
        "Location Description": "location_description",
        "Arrest": "arrest",
        "Beat": "beat",
        "District": "district",
        "Community Area": "community_area",
        "Latitude": "latitude",
        "Longitude": "longitude",
    },
    "arrests": {
        "CB_NO": "cb_no",
        "CASE NUMBER": "case_number",
        "ARREST DATE": "arrest_date",
        "RACE": "race",
        "CHARGE 1 DESCRIPTION": "charge_description",
        "CHARGE 1 TYPE": "charge_type",
        "CHARGE 1 CLASS": "charge_class",
        "CHARGES DESCRIPTION": "charges_description",
    },
    "violence": {
        "CASE_NUMBER": "case_number",
        "DATE": "date",
        "HOUR": "hour",
        "MONTH": "month",
        "BLOCK": "block",
        "DISTRICT": "district",
        "BEAT": "beat",
        "COMMUNITY_AREA": "community_area",
        "LOCATION_DESCRIPTION": "location_description",
        "VICTIMIZATION_PRIMARY": "victimization_primary",
        "INCIDENT_PRIMARY": "incident_primary",
        "GUNSHOT_INJURY_I": "gunshot_injury",
        "LATITUDE": "latitude",
        "LONGITUDE": "longitude",
    },
    "sex-offenders": {
        "LAST": "last",
        "FIRST": "first",
        "BLOCK": "block",
        "GENDER": "gender",
        "RACE": "race",
        "BIRTH DATE": "birth_date",
        "VICTIM MINOR": "victim_minor",
    },
    "police-stations": {
        "DISTRICT": "district",
        "DISTRICT NAME": "district_name",
        "ADDRESS": "address",
        "LATITUDE": "latitude",
        "LONGITUDE": "longitude",
    },
}

STREAMED_DATASETS = ("violence", "crimes", "arrests", "sex-offenders")


def raw_schema(dataset: str) -> T.StructType:
    """All-text schema with the CSV's own header names."""
    return T.StructType([T.StructField(h, _S) for h in RAW_COLUMNS[dataset]])


UNIFIED_EVENT = _struct(
    ("event_id", _S, False),
    ("source_dataset", _S, False),
    ("victim_id", _S),
    ("incident_date", _S, False),
    ("incident_time", _S),
    ("location", _S),
    ("district", _S),
    ("beat", _S),
    ("crime_type", _S),
    ("injury_type", _S),
    ("severity", _I),
    ("latitude", _S),
    ("longitude", _S),
    ("is_arrest", _B),
    ("processed_timestamp", _L, False),
)
UNIFIED_COLUMNS = UNIFIED_EVENT.fieldNames()

# The event as an Avro record: same fields, nullable ones as a union with null.
_AVRO_TYPES = {"string": "string", "int": "int", "boolean": "boolean", "bigint": "long"}
EVENT_AVRO_SCHEMA = {
    "type": "record",
    "name": "SafetyEvent",
    "fields": [
        {"name": f.name, "type": ["null", _AVRO_TYPES[f.dataType.simpleString()]], "default": None}
        if f.nullable
        else {"name": f.name, "type": _AVRO_TYPES[f.dataType.simpleString()]}
        for f in UNIFIED_EVENT
    ],
}

# One alert message: the event, its display label and the API clock in milliseconds.
ALERT_COLUMNS = [
    *UNIFIED_COLUMNS[:10],
    "event_label",
    *UNIFIED_COLUMNS[10:],
    "processed_timestamp_api",
]
ALERT_MESSAGE = T.StructType(
    [
        T.StructField(
            name,
            _S if name == "event_label" else _L if name == "processed_timestamp_api" else UNIFIED_EVENT[name].dataType,
        )
        for name in ALERT_COLUMNS
    ]
)

# Result-table contracts.
TABLES: dict[str, T.StructType] = {
    "crime_trends": _struct(("year", _I), ("month", _I), ("day_of_week", _I), ("hour", _I), ("crime_count", _L)),
    "arrest_rate_analysis": _struct(
        ("primary_type", _S),
        ("district", _S),
        ("race", _S),
        ("total_crimes", _L),
        ("total_arrests", _L),
        ("arrest_rate", _D),
    ),
    "top_arrest_rate_crime_types": _struct(
        ("primary_type", _S), ("total_crimes", _L), ("total_arrests", _L), ("arrest_rate", _D)
    ),
    "violence_analysis": _struct(
        ("month", _I),
        ("district", _S),
        ("homicides", _L),
        ("non_fatal_shootings", _L),
        ("gunshot_incidents", _L),
        ("total_incidents", _L),
        ("gunshot_proportion_overall", _D),
    ),
    "top_violence_community": _struct(("community_area", _S), ("incident_count", _L)),
    "sex_offender_proximity": _struct(
        ("offender_name", _S),
        ("block", _S),
        ("race", _S),
        ("gender", _S),
        ("victim_minor", _S),
        ("is_victim_minor", _B),
        ("priority_flag", _S),
    ),
    "district_offender_density": _struct(
        ("district", _S),
        ("district_name", _S),
        ("station_address", _S),
        ("station_lat", _D),
        ("station_lon", _D),
        ("total_registered_offenders", _L),
        ("minor_victim_offenders", _L),
    ),
    "hotspots": _struct(
        ("cluster_id", _I),
        ("crime_count", _L),
        ("avg_lat", _D),
        ("avg_lon", _D),
        ("primary_types", _S),
        ("centroid_lat", _D),
        ("centroid_lon", _D),
    ),
    "correlations": _struct(
        ("correlation_type", _S),
        ("group_key", _S),
        ("community_area", _S),
        ("total_crimes", _L),
        ("total_arrests", _L),
        ("metric_a", _D),
        ("violence_incidents", _L),
        ("metric_b", _D),
        ("sex_offender_count", _L),
    ),
    "alerts": _struct(
        ("source_dataset", _S),
        ("district", _S),
        ("window_start", _TS),
        ("window_end", _TS),
        ("event_count", _L),
        ("window_first_event", _TS),
        ("window_last_event", _TS),
        ("threshold", _I),
        ("detected_at", _TS),
        ("alert_severity", _S),
    ),
    "events": T.StructType(
        [
            T.StructField("kafka_timestamp", _TS),
            *UNIFIED_EVENT.fields,
            T.StructField("event_label", _S),
            T.StructField("processed_at", _TS),
            T.StructField("received_lag_ms", _L),
            T.StructField("is_alert", _B),
        ]
    ),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Select the table's columns in contract order; raise when a name or type differs."""
    want = TABLES[table]
    have = {f.name: f.dataType for f in df.schema}
    wrong = [
        f"{f.name}: want {f.dataType.simpleString()}, have "
        + (have[f.name].simpleString() if f.name in have else "nothing")
        for f in want
        if have.get(f.name) != f.dataType
    ]
    extra = sorted(set(have) - set(want.fieldNames()))
    if wrong or extra:
        raise ValueError(f"table {table} breaks its contract: {wrong} extra={extra}")
    return df.select(*want.fieldNames())
