"""Raw rows to unified events, from CSV text on."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from beatwatch.operators import normalise
from beatwatch.schemas import UNIFIED_COLUMNS, raw_schema
from beatwatch.sources import csv_files

VIOLENCE = '''CASE_NUMBER,DATE,HOUR,MONTH,BLOCK,DISTRICT,BEAT,COMMUNITY_AREA,LOCATION_DESCRIPTION,VICTIMIZATION_PRIMARY,INCIDENT_PRIMARY,GUNSHOT_INJURY_I,LATITUDE,LONGITUDE
JG1,05/02/2026 11:49:00 PM,23,5,"100 W ""A"" ST,
REAR",011,1112,AUSTIN,,HOMICIDE,,NO,41.1,-87.1
JG2,05/03/2026,7,,B2,11,,,STREET,,SHOOTING,YES,,
JG3,,,,,,,,,NON-FATAL SHOOTING,,NO,x,y
'''
OFFENDERS = '''LAST,FIRST,BLOCK,GENDER,RACE,BIRTH DATE,VICTIM MINOR
 DOE ,JOHN,B1,MALE,WHITE,01/02/1960,Y
ROE,,B2,MALE,,,N
,ANN,B3,FEMALE,BLACK,02/03/1970,
'''
STATIONS = '''DISTRICT,DISTRICT NAME,ADDRESS,LATITUDE,LONGITUDE
1,Central,1718 S State,41.85,-87.62
2,Short row
3,Long,Addr,41.0,-87.0,extra,fields
'''


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("csv")
    (root / "Violence_Reduction_-_Victims.csv").write_text(VIOLENCE)
    (root / "Sex_Offenders.CSV.csv").write_text(OFFENDERS)
    (root / "POLICE_STATIONS.csv").write_text(STATIONS)
    (root / "notes_violence.txt").write_text("not a csv")
    return str(root)


def test_find_reads_quotes_and_newlines(spark, folder):
    raw = csv_files.project(csv_files.find_csv(spark, folder, "IOLENCE", "violence"), "violence")
    rows = {r["case_number"]: r for r in raw.collect()}
    assert len(rows) == 3
    assert rows["JG1"]["block"] == '100 W "A" ST,\nREAR'
    assert rows["JG3"]["date"] is None
    with pytest.raises(FileNotFoundError):
        csv_files.find_csv(spark, folder, "arrests", "arrests")


def test_file_name_rules(spark):
    names = ["Violence_crimes.csv", "CRIMES_arrests.csv", "Arrests.csv", "sex offenders.csv", "Police_Stations.csv", "x.csv"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(csv_files.classify(F.col("n")).alias("dataset"))
    assert [r[0] for r in got.collect()] == ["violence", "crimes", "arrests", "sex-offenders", "police-stations", "unknown"]
    assert csv_files.streamed_only(got).count() == 4


def test_classify_by_scanned_file(spark, folder):
    lines = spark.read.text(folder).select(csv_files.classify(F.col("_metadata.file_name")).alias("dataset"))
    assert {r[0] for r in lines.distinct().collect()} == {"violence", "sex-offenders", "police-stations"}


def test_rows_with_wrong_field_count_go_to_quarantine(spark, folder, tmp_path):
    raw = csv_files.read_csv(spark, f"{folder}/POLICE_STATIONS.csv", raw_schema("police-stations"), keep_corrupt=True)
    landed, counts = csv_files.land_counted(csv_files.project(raw, "police-stations"), str(tmp_path / "s"))
    assert counts == {"read": 3, "malformed": 2}
    good, bad = csv_files.split_corrupt(landed)
    assert [r["district"] for r in good.collect()] == ["1"]
    assert sorted(r["record"] for r in bad.collect()) == ["2,Short row", "3,Long,Addr,41.0,-87.0,extra,fields"]


def test_violence_events(spark, folder):
    raw = csv_files.project(csv_files.find_csv(spark, folder, "iolence", "violence"), "violence")
    events = normalise.violence_events(raw)
    assert events.columns == UNIFIED_COLUMNS
    rows = {r["victim_id"]: r for r in events.collect()}
    first, second, third = rows["JG1"], rows["JG2"], rows["JG3"]
    assert (first["incident_date"], first["incident_time"], first["severity"]) == ("05/02/2026", "11:49:00", 5)
    assert first["location"].startswith("100 W") and first["crime_type"] == "HOMICIDE" and first["is_arrest"] is None
    # the hour stands in for a missing time, the incident for a missing victimisation
    assert (second["incident_time"], second["crime_type"], second["injury_type"], second["severity"]) == ("07:00", "SHOOTING", None, 4)
    assert (third["incident_date"], third["incident_time"], third["district"], third["severity"]) == ("unknown", None, None, 5)
    clock = {r["victim_id"]: r["incident_time"] for r in normalise.violence_events(raw, clock="24h").collect()}
    assert clock["JG1"] == "23:49:00"


def test_offender_events(spark, folder):
    raw = csv_files.project(csv_files.find_csv(spark, folder, "ex_Off", "sex-offenders"), "sex-offenders")
    rows = sorted(normalise.offender_events(raw).collect(), key=lambda r: r["location"])
    assert [r["victim_id"] for r in rows] == ["DOE JOHN", "ROE", None]
    assert [r["incident_date"] for r in rows] == ["01/02/1960", "unknown", "02/03/1970"]
    assert [r["injury_type"] for r in rows] == ["VICTIM_MINOR:Y", "VICTIM_MINOR:N", None]
    assert [r["severity"] for r in rows] == [5, 3, 3]
    assert {r["district"] for r in rows} == {None}


def test_crime_and_arrest_events(spark):
    crimes = spark.createDataFrame(
        [("C1", "05/02/2026 01:00:00 AM", "B", "THEFT", "d", "", " Yes ", "1", "2", "3", "41", "-87"), ("C2", None, "", None, "d", " ", None, "1", "2", "3", "", None)],
        ", ".join(f"{c} string" for c in ("case_number", "date", "block", "primary_type", "description", "location_description", "arrest", "beat", "district", "community_area", "latitude", "longitude")),
    )
    one, two = sorted(normalise.crime_events(crimes).collect(), key=lambda r: r["victim_id"])
    assert (one["location"], one["is_arrest"], one["severity"]) == ("B", True, 3)
    assert (two["location"], two["is_arrest"], two["crime_type"], two["latitude"]) == (" ", None, None, None)
    arrests = spark.createDataFrame(
        [(None, "HZ1", "05/02/2026 01:00:00 AM", "BLACK", "", "F", "x", "ALL"), ("CB", "HZ1", "", None, "ONE", "M", None, "ALL")],
        ", ".join(f"{c} string" for c in ("cb_no", "case_number", "arrest_date", "race", "charge_description", "charge_type", "charge_class", "charges_description")),
    )
    rows = {r["victim_id"]: r for r in normalise.arrest_events(arrests).collect()}
    assert rows["HZ1"]["crime_type"] == "ALL" and rows["HZ1"]["severity"] == 5 and rows["HZ1"]["district"] is None
    assert rows["CB"]["crime_type"] == "ONE" and rows["CB"]["incident_date"] == "unknown" and rows["CB"]["is_arrest"] is True


def test_replaying_rows_gives_the_same_ids(spark, folder):
    raw = csv_files.project(csv_files.find_csv(spark, folder, "iolence", "violence"), "violence")
    ids = lambda **o: sorted(r["event_id"] for r in normalise.unify({"violence": raw}, **o).collect())
    assert ids() == ids()
    assert ids(ids="random") != ids(ids="random")


def test_json_messages_need_every_field(spark):
    fields = normalise.JSON_REQUIRED
    full = tuple(f" {c} " for c in fields)
    rows = [full, (*full[:-1], " "), (*full[:-1], None)]
    got = normalise.json_messages(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in fields))).collect()
    assert [r["accepted"] for r in got] == [True, False, False]
    assert got[0]["key"] == "case_number" and '"block":"block"' in got[0]["value"] and got[1]["value"] is None
