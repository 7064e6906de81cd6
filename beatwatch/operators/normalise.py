"""Raw dataset rows (text, snake_case) to the unified 15-column event."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwatch.functions import severity as sev
from beatwatch.functions.ids import content_id, random_id
from beatwatch.functions.text import null_if_empty, pad_left, truthy
from beatwatch.functions.times import UNKNOWN_DATE, split_date, split_time
from beatwatch.schemas import UNIFIED_COLUMNS, UNIFIED_EVENT

OFFENDER_CRIME_TYPE = "SEX OFFENDER REGISTRATION"
_BODY = [c for c in UNIFIED_COLUMNS if c not in ("event_id", "processed_timestamp")]


def _event(df: DataFrame, dataset: str, ids: str | Column, now: Column | None, **fields: Column) -> DataFrame:
    """Fill the unified columns; those not given are typed nulls, empty text becomes null.

    ``ids``: 'content' (equal rows share an id; ``numbering.unique_ids`` tells them apart once they are written),
    'random', or a column of the rows that tells them apart.
    """

    def one(name: str) -> Column:
        kind = UNIFIED_EVENT[name].dataType
        value = fields.get(name, F.lit(None)).cast(kind)
        if kind.simpleString() == "string" and UNIFIED_EVENT[name].nullable:
            value = null_if_empty(value)
        return value.alias(name)

    placed = isinstance(ids, Column)
    place = [ids.alias("_place")] if placed else []
    body = df.select(F.lit(dataset).alias("source_dataset"), *[one(c) for c in _BODY if c != "source_dataset"], *place)
    event_id = content_id(*_BODY, "_place") if placed else content_id(*_BODY) if ids == "content" else random_id()
    stamp = now if now is not None else F.unix_millis(F.current_timestamp())
    return body.select(event_id.alias("event_id"), *_BODY, stamp.cast("long").alias("processed_timestamp"))


def _place(location: str = "location_description", block: str = "block") -> Column:
    return F.coalesce(null_if_empty(location), null_if_empty(block))


def violence_events(df: DataFrame, clock: str = "as_is", ids: str | Column = "content", now: Column | None = None) -> DataFrame:
    hour = null_if_empty("hour")
    victim = null_if_empty("victimization_primary")
    return _event(
        df,
        "violence",
        ids,
        now,
        victim_id=F.col("case_number"),
        incident_date=split_date("date"),
        incident_time=F.coalesce(split_time("date", clock), F.concat(pad_left(F.trim(hour), 2), F.lit(":00"))),
        location=_place(),
        district=F.col("district"),
        beat=F.col("beat"),
        crime_type=F.coalesce(victim, null_if_empty("incident_primary")),
        injury_type=victim,
        severity=sev.severity_violence("gunshot_injury", "victimization_primary"),
        latitude=F.col("latitude"),
        longitude=F.col("longitude"),
    )


def crime_events(df: DataFrame, clock: str = "as_is", ids: str | Column = "content", now: Column | None = None) -> DataFrame:
    return _event(
        df,
        "crimes",
        ids,
        now,
        victim_id=F.col("case_number"),
        incident_date=split_date("date"),
        incident_time=split_time("date", clock),
        location=_place(),
        district=F.col("district"),
        beat=F.col("beat"),
        crime_type=F.col("primary_type"),
        injury_type=F.col("description"),
        severity=sev.severity_crime("primary_type"),
        latitude=F.col("latitude"),
        longitude=F.col("longitude"),
        is_arrest=truthy(null_if_empty("arrest")),
    )


def arrest_events(df: DataFrame, clock: str = "as_is", ids: str | Column = "content", now: Column | None = None) -> DataFrame:
    return _event(
        df,
        "arrests",
        ids,
        now,
        victim_id=F.coalesce(null_if_empty("cb_no"), F.col("case_number")),
        incident_date=split_date("arrest_date"),
        incident_time=split_time("arrest_date", clock),
        crime_type=F.coalesce(null_if_empty("charge_description"), null_if_empty("charges_description")),
        injury_type=F.col("charge_type"),
        severity=sev.severity_arrest("charge_class"),
        is_arrest=F.lit(True),
    )


def offender_events(df: DataFrame, ids: str | Column = "content", now: Column | None = None) -> DataFrame:
    last, first = null_if_empty("last"), null_if_empty("first")
    minor = null_if_empty("victim_minor")
    return _event(
        df,
        "sex-offenders",
        ids,
        now,
        victim_id=F.when(first.isNull(), last).otherwise(F.concat(F.trim(last), F.lit(" "), F.trim(first))),
        incident_date=F.coalesce(null_if_empty("birth_date"), F.lit(UNKNOWN_DATE)),
        location=F.col("block"),
        crime_type=F.lit(OFFENDER_CRIME_TYPE),
        injury_type=F.concat(F.lit("VICTIM_MINOR:"), F.trim(minor)),
        severity=sev.severity_offender("victim_minor"),
    )


NORMALISERS = {
    "violence": violence_events,
    "crimes": crime_events,
    "arrests": arrest_events,
    "sex-offenders": offender_events,
}


def unify(raw: dict[str, DataFrame], clock: str = "as_is", ids: str | Column = "content", now: Column | None = None) -> DataFrame:
    """One event stream from any of the four streamed datasets; works for batch and streams."""
    parts = []
    for dataset, df in raw.items():
        options = {"ids": ids, "now": now}
        if dataset != "sex-offenders":
            options["clock"] = clock
        parts.append(NORMALISERS[dataset](df, **options))
    return reduce(lambda a, b: a.unionByName(b), parts)


# Fields a crime needs for its JSON message.
JSON_REQUIRED = ("case_number", "date", "block", "primary_type", "district", "arrest", "latitude", "longitude")


def json_messages(crimes: DataFrame, required: tuple[str, ...] = JSON_REQUIRED) -> DataFrame:
    """(key, value, accepted): the trimmed fields as JSON when none is blank, else value null."""
    trimmed = [F.trim(F.col(c)).alias(c) for c in required]
    slim = crimes.select(*trimmed)
    complete = reduce(lambda a, b: a & b, [F.coalesce(F.col(c) != "", F.lit(False)) for c in required])
    return slim.select(
        F.col(required[0]).alias("key"),
        F.when(complete, F.to_json(F.struct(*required))).alias("value"),
        complete.alias("accepted"),
    )
