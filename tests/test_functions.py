"""Column functions on the awkward values of the datasets."""

from __future__ import annotations

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beatwatch.functions import envelope, ids, labels, severity, text, times
from beatwatch.schemas import UNIFIED_EVENT


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize(
    ("gunshot", "primary", "want"),
    [
        ("YES", "HOMICIDE", 4),  # a confirmed gunshot comes first
        (" yes ", None, 4),
        ("NO", "HOMICIDE", 5),
        ("NO", "NON-FATAL SHOOTING", 5),  # 'fatal' is a substring
        (None, "Shooting", 4),
        ("", "Chest wound", 3),
        ("NO", "ARMED ENCOUNTER", 2),  # 'arm' is a substring
        ("NO", "BATTERY", 1),
        (None, None, 1),
    ],
)
def test_violence_severity(spark, gunshot, primary, want):
    assert values(spark, [(gunshot, primary)], "g string, p string", severity.severity_violence("g", "p")) == [want]


def test_crime_severity(spark):
    rows = [("HOMICIDE",), ("battery",), ("THEFT",), ("FRAUD",), ("OTHER",), (" ARSON",), (None,), ("CRIMINAL SEXUAL ASSAULT",), ("CRIM SEXUAL ASSAULT",)]
    assert values(spark, rows, "t string", severity.severity_crime("t")) == [5, 4, 3, 2, 1, 1, 1, 4, 3]


def test_arrest_and_offender_severity(spark):
    rows = [("X",), (" x ",), ("1",), ("2",), ("3",), ("4",), ("a",), ("B",), (None,)]
    assert values(spark, rows, "c string", severity.severity_arrest("c")) == [5, 5, 4, 4, 3, 3, 2, 1, 1]
    rows = [("Y",), (" y ",), ("N",), ("",), (None,)]
    assert values(spark, rows, "m string", severity.severity_offender("m")) == [5, 5, 3, 3, 3]


def test_split_datetime(spark):
    rows = [("05/02/2026 11:49:00 PM",), ("05/02/2026",), ("",), (None,), ("  05/02/2026   01:02:03 AM ",), ("   ",)]
    dates = values(spark, rows, "d string", times.split_date("d"))
    clock = values(spark, rows, "d string", times.split_time("d"))
    assert dates == ["05/02/2026", "05/02/2026", "unknown", "unknown", "05/02/2026", ""]
    assert clock == ["11:49:00", None, None, None, "01:02:03", None]
    full = values(spark, rows, "d string", times.split_time("d", clock="24h"))
    assert full == ["23:49:00", None, None, None, "01:02:03", None]
    with pytest.raises(ValueError):
        times.split_time("d", clock="12h")


def test_event_time_falls_through_bad_text(spark):
    ingest = datetime(2026, 1, 1, 12)
    rows = [
        ("05/02/2026", "11:49:00", ingest),
        ("05/02/2026", "07:00", ingest),  # the hour fallback has no seconds
        ("05/02/2026", None, ingest),
        ("05/02/2026", "soon", ingest),
        ("unknown", None, ingest),
        ("", "10:00:00", ingest),
    ]
    got = values(spark, rows, "d string, t string, k timestamp", times.event_time("d", "t", "k"))
    day = datetime(2026, 5, 2)
    assert got == [day.replace(hour=11, minute=49), day.replace(hour=7), day, day, ingest, ingest]


def test_truthy_keeps_null(spark):
    rows = [("true",), (" Yes ",), ("1",), ("FALSE",), ("",), (None,)]
    assert values(spark, rows, "a string", text.truthy("a")) == [True, True, True, False, False, None]


def test_null_if_empty_keeps_blanks(spark):
    assert values(spark, [("",), (" ",), ("x",), (None,)], "a string", text.null_if_empty("a")) == [None, " ", "x", None]


def test_district_keys(spark):
    rows = [("11",), ("011",), (" 0011 ",), ("1234",), ("000",), (None,)]
    assert values(spark, rows, "d string", text.district_key("d")) == ["011", "011", "011", "1234", "000", None]
    rows = [("11",), ("011",), ("N/A",), ("",), (None,)]
    assert values(spark, rows, "d string", text.district_number("d")) == [11, 11, None, None, None]


def test_first_items_and_labels(spark):
    assert values(spark, [("a, b, c, d",), ("a",), ("",)], "l string", text.first_items("l")) == ["a, b, c", "a", ""]
    assert values(spark, [(5,), (1,), (9,), (None,)], "s int", labels.severity_label("s")) == ["CRITICAL", "INFO", "INFO", "INFO"]
    rows = [("sex-offenders",), ("bikes",), (None,)]
    assert values(spark, rows, "d string", labels.dataset_label("d")) == ["SEX OFFENDERS", "BIKES", "UNKNOWN"]
    rows = [(4.5,), (4.0,), (3.0,), (2.9,)]
    assert values(spark, rows, "a double", labels.severity_band("a")) == ["red", "orange", "yellow", "cyan"]
    assert values(spark, [(0.51,), (0.5,), (0.25,)], "r double", labels.rate_band("r")) == ["red", "yellow", "green"]
    rows = [("", "inj"), ("crime", "inj"), (None, None)]
    assert values(spark, rows, "c string, i string", labels.event_label("c", "i")) == ["inj", "crime", None]


def test_lag_has_whole_seconds(spark):
    rows = [(datetime(2026, 1, 1, 0, 0, 2, 100_000), datetime(2026, 1, 1, 0, 0, 0, 900_000))]
    schema = "a timestamp, b timestamp"
    assert values(spark, rows, schema, times.lag_ms("a", "b")) == [2000]
    assert values(spark, rows, schema, times.lag_ms("a", "b", exact=True)) == [1200]


def test_content_ids_tell_nulls_apart(spark):
    rows = [("a", None), (None, "a"), ("a", ""), ("a", None)]
    got = values(spark, rows, "x string, y string", ids.content_id("x", "y"))
    assert got[0] == got[3] and len(set(got)) == 3


def test_header(spark):
    rows = [(b"\x00\x00\x00\x01\x02body",), (b"12345",), (b"",), (None,)]
    got = values(spark, rows, "v binary", envelope.strip_header("v"))
    assert [bytes(v) if v is not None else None for v in got] == [b"body", b"12345", b"", None]
    framed = values(spark, [(b"x",)], "v binary", envelope.add_header(F.col("v"), 258))
    assert bytes(framed[0]) == b"\x00\x00\x00\x01\x02x"


event = st.fixed_dictionaries(
    {
        "event_id": st.text(min_size=1, max_size=8, alphabet=st.characters(codec="utf-8", exclude_characters="\x00")),
        "district": st.none() | st.text(max_size=4, alphabet="0123 ,\"\\\n"),
        "severity": st.none() | st.integers(1, 5),
        "is_arrest": st.none() | st.booleans(),
        "processed_timestamp": st.integers(0, 2**53),
    }
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(event, min_size=1, max_size=6), st.integers(0, 2**31 - 1))
def test_decode_undoes_encode(spark, events, schema_id):
    names = UNIFIED_EVENT.fieldNames()
    rows = [tuple(e.get(n, "x" if not UNIFIED_EVENT[n].nullable else None) for n in names) for e in events]
    df = spark.createDataFrame(rows, UNIFIED_EVENT)
    wire = df.select(envelope.encode(F.struct(*names), schema_id).alias("v"))
    back = wire.select(envelope.decode("v").alias("e")).select("e.*")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
