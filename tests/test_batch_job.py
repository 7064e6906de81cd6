"""The batch job from CSV files to the nine tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from beatwatch.plans import batch_job, ingest_job
from beatwatch.plans.registry import Tables
from beatwatch.schemas import RAW_COLUMNS, TABLES
from beatwatch.sinks.topics import TopicTarget
from beatwatch.sources.csv_files import find_csv
from beatwatch.sources.tables import read_table
from beatwatch.sources.topics import decode_events

FILES = {
    "crimes": "Crimes_-_2001_to_Present.csv",
    "arrests": "Arrests_20240101.csv",
    "violence": "Violence_Reduction_Victims.csv",
    "sex-offenders": "Sex_Offenders.csv",
    "police-stations": "Police_Stations.csv",
}


@pytest.fixture(scope="module")
def data_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    t = Tables(spark, "/root/testdata/sf0.001")
    frames = {"crimes": t.crimes, "arrests": t.arrests, "violence": t.violence, "sex-offenders": t.offenders, "police-stations": t.stations}
    for dataset, df in frames.items():
        # as published: other columns among ours, in another order
        headed = df.select(F.lit("1").alias("ID"), *reversed([F.col(c).alias(h) for h, c in RAW_COLUMNS[dataset].items()]), F.lit("x, y").alias("Location"))
        headed.toPandas().to_csv(root / FILES[dataset], index=False)
        with (root / FILES[dataset]).open("a") as out:
            out.write("too,short\n")
    return str(root)


def test_nine_tables_with_their_contracts(spark, data_dir, tmp_path):
    out = str(tmp_path / "tables")
    names = batch_job.run(spark, data_dir, out, k=4, min_crimes=50, partitions=3)
    assert len(names) == 9
    for name in names:
        df = read_table(spark, out, name)
        assert df.schema.simpleString() == TABLES[name].simpleString()
        assert df.count() > 0, name
    crimes = Tables(spark, "/root/testdata/sf0.001").crimes.count()
    assert read_table(spark, out, "crime_trends").agg(F.sum("crime_count")).first()[0] == crimes
    assert read_table(spark, out, "arrest_rate_analysis").agg(F.sum("total_crimes")).first()[0] == crimes
    assert read_table(spark, out, "hotspots").count() == 4
    counts = {r["dataset"]: (r["read"], r["malformed"]) for r in spark.read.parquet(f"{out}/row_counts").collect()}
    assert counts["crimes"] == (crimes + 1, 1) and all(bad == 1 for _, bad in counts.values())
    assert spark.read.parquet(f"{out}/malformed/crimes").count() == 1
    first = {n: sorted(map(str, read_table(spark, out, n).collect())) for n in names if n != "hotspots"}
    batch_job.run(spark, data_dir, out, k=4, min_crimes=50)
    assert first == {n: sorted(map(str, read_table(spark, out, n).collect())) for n in first}


def test_a_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "Police_Stations.csv").write_text("DISTRICT,ADDRESS\n1,x\n")
    with pytest.raises(ValueError, match="no column"):
        find_csv(spark, str(tmp_path), "tations", "police-stations")


def test_ingest_publishes_every_good_row_once(spark, data_dir, tmp_path):
    bus, landing = str(tmp_path / "bus"), str(tmp_path / "landing")
    counts = {r["dataset"]: r for r in ingest_job.publish(spark, data_dir, landing, TopicTarget(folder=bus), partitions=2).collect()}
    assert sorted(counts) == ["arrests", "crimes", "sex-offenders", "violence"]
    events = decode_events(spark.read.parquet(f"{bus}/raw").withColumn("timestamp", F.current_timestamp()))
    got = {r["source_dataset"]: (r["n"], r["ids"]) for r in events.groupBy("source_dataset").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids")).collect()}
    for dataset, r in counts.items():
        assert r["malformed"] == 1 and r["published"] == r["read"] - 1 and got[dataset] == (r["published"], r["published"])
