"""Streams: parity with batch, late data, retries, failing sinks, restarts."""

from __future__ import annotations

import json
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from beatwatch.operators import windows
from beatwatch.operators.enrich import enrich, valid_events, with_event_time
from beatwatch.plans.stream_app import STREAM_CONF, start_all
from beatwatch.schemas import ALERT_COLUMNS, TABLES, UNIFIED_COLUMNS, UNIFIED_EVENT
from beatwatch.session import shared_dir
from beatwatch.sinks import tables
from beatwatch.sinks.topics import TopicTarget, alert_messages, raw_messages
from beatwatch.sources import topics
from beatwatch.sources.tables import read_table
from beatwatch.streaming.batches import Outputs, anomaly_fan_out, fan_out, to_console, to_table
from beatwatch.streaming.queries import start_main, start_malformed, start_metrics, start_volume

START = datetime(2024, 1, 1)
ONCE = {"availableNow": True}


def events(spark, n=400, at=START):
    """Unified events, a third of them in one district, some without one."""
    names = UNIFIED_EVENT.fieldNames()
    rows = []
    for i in range(n):
        e = dict.fromkeys(names)
        e.update(
            event_id=f"{at:%j}-{i:05d}",
            source_dataset=("crimes", "violence", "arrests")[i % 3],
            incident_date="" if i % 40 == 0 else f"{at:%m/%d/%Y}",
            incident_time=f"{at + timedelta(seconds=i):%H:%M:%S}",
            district="hot" if i % 3 == 0 else None if i % 20 == 1 else f"{i % 5:03d}",
            crime_type="" if i % 7 == 0 else "THEFT",
            injury_type="INJ",
            severity=None if i % 11 == 0 else i % 5 + 1,
            processed_timestamp=i,
        )
        rows.append(tuple(e[c] for c in names))
    df = spark.createDataFrame(rows, UNIFIED_EVENT)
    ingest = F.timestamp_seconds(F.lit(int(at.timestamp())) + F.col("processed_timestamp"))
    return df.withColumn("kafka_timestamp", ingest)


@pytest.fixture
def bus(spark):
    """A folder of event files and a stream over it."""
    path = shared_dir(spark, "bus")
    first = events(spark)
    first.repartition(3).write.parquet(path)
    return path, first


def stream(spark, path, schema):
    return topics.replay(spark, path, schema, files_per_batch=1)


def finish(*queries):
    for q in queries:
        q.awaitTermination()


def outputs(spark, **options):
    root = shared_dir(spark, "out")
    return Outputs(root, options.pop("topics", TopicTarget(folder=f"{root}/topics")), **options)


def test_fan_out_over_several_batches(spark, bus):
    path, first = bus
    out, checkpoint = outputs(spark), shared_dir(spark, "checkpoint")
    finish(start_main(enrich(stream(spark, path, first.schema)), out, checkpoint, **ONCE))
    stored = tables.read_batches(spark, f"{out.root}/events")
    assert stored.count() == 400 and stored.select("batch_id").distinct().count() == 3
    assert set(stored.columns) - {"batch_id"} == set(TABLES["events"].fieldNames())
    alerts = first.filter("severity >= 3").count()
    sent = tables.read_batches(spark, f"{out.root}/topics/alerts")
    assert sent.count() == alerts
    assert {r[0] for r in sent.select("topic").distinct().collect()} == {"alerts-crimes", "alerts-violence", "alerts-arrests"}
    body = json.loads(sent.filter("key = '001-00002'").first()["value"])
    assert body["event_label"] == "THEFT" and body["source_dataset"] == "arrests" and "processed_timestamp_api" in body
    documents = spark.read.json(f"{out.root}/alert_documents")
    assert documents.count() == alerts
    # nothing new, nothing written
    finish(start_main(enrich(stream(spark, path, first.schema)), out, checkpoint, **ONCE))
    assert tables.read_batches(spark, f"{out.root}/events").count() == 400


def test_a_repeated_batch_replaces_itself(spark):
    out = outputs(spark)
    body, batch = fan_out(out), enrich(events(spark, 60))
    for _ in range(2):
        body(batch, 7)
    body(batch.limit(0), 8)  # an empty batch writes nothing
    assert tables.read_batches(spark, f"{out.root}/events").count() == 60
    again = anomaly_fan_out(out, "volume")
    volume = windows.volume_windows(with_event_time(valid_events(events(spark, 300))))
    anomalies = windows.volume_anomalies(volume, threshold=20)
    for _ in range(2):
        again(anomalies, 1)
    assert tables.read_batches(spark, f"{out.root}/volume_alerts").count() == anomalies.count() > 0
    assert tables.read_batches(spark, f"{out.root}/topics/volume").count() == anomalies.count()


def test_failing_sink_fails_the_batch_unless_best_effort(spark):
    batch = enrich(events(spark, 30))
    with pytest.raises(ValueError, match="brokers"):
        fan_out(outputs(spark, topics=TopicTarget()))(batch, 0)
    out = outputs(spark, topics=TopicTarget(), best_effort=True)
    fan_out(out)(batch, 0)
    assert tables.read_batches(spark, f"{out.root}/events").count() == 30


def test_stream_windows_equal_batch_windows(spark, bus):
    path, first = bus
    out, checkpoint = shared_dir(spark, "volume"), shared_dir(spark, "checkpoint")
    timed = with_event_time(valid_events(stream(spark, path, first.schema)))
    rows = windows.volume_windows(timed, watermark="1 day")
    finish(rows.writeStream.outputMode("update").foreachBatch(to_table(out)).option("checkpointLocation", checkpoint).trigger(**ONCE).start())
    keys = ["source_dataset", "district", "window_start", "window_end"]
    streamed = tables.newest_per_key(tables.read_batches(spark, out), keys)
    batch = windows.volume_windows(with_event_time(valid_events(first)))
    same = [*keys, "event_count", "window_first_event", "window_last_event"]
    assert Counter(map(tuple, streamed.select(same).collect())) == Counter(map(tuple, batch.select(same).collect()))
    # three micro-batches: windows were re-emitted and only the last version counts
    assert tables.read_batches(spark, out).count() > streamed.count()


def test_late_events_are_dropped(spark):
    path, out, checkpoint = (shared_dir(spark, n) for n in ("late", "out", "checkpoint"))
    for day in (5, 1):  # the newer day first
        events(spark, 100, START + timedelta(days=day)).write.mode("append").parquet(path)
        timed = with_event_time(valid_events(topics.replay(spark, path, events(spark, 1).schema)))
        rows = windows.volume_windows(timed, watermark="10 minutes")
        finish(rows.writeStream.outputMode("update").foreachBatch(to_table(out)).option("checkpointLocation", checkpoint).trigger(**ONCE).start())
    days = tables.read_batches(spark, out).select(F.dayofmonth("window_end")).distinct().collect()
    assert {d[0] for d in days} == {6}


def test_volume_and_malformed_queries(spark, bus):
    path, first = bus
    out, checkpoint = outputs(spark), shared_dir(spark, "checkpoint")
    finish(
        start_volume(stream(spark, path, first.schema), out, checkpoint, threshold=20, windows={"watermark": "1 day"}, **ONCE),
        start_malformed(stream(spark, path, first.schema), f"{out.root}/malformed", checkpoint, **ONCE),
    )
    message = json.loads(tables.read_batches(spark, f"{out.root}/topics/volume").first()["value"])
    assert message["alert_type"] == "volume_threshold" and message["threshold"] == 20
    dead = tables.read_batches(spark, f"{out.root}/malformed")
    assert dead.count() == first.count() - valid_events(first).count() > 0
    assert dead.filter("invalid_reason is null").count() == 0


def test_whole_application(spark, bus):
    path, first = bus
    out = outputs(spark)
    for key, value in STREAM_CONF.items():  # state in RocksDB, as on a cluster
        spark.conf.set(key, value)
    running = start_all(stream(spark, path, first.schema), out, shared_dir(spark, "checkpoint"), threshold=10, **ONCE)
    assert sorted(q.name for q in running) == ["active", "buffer", "counters", "main", "malformed", "metrics", "volume", "zscore"]
    finish(*running)
    for key in STREAM_CONF:
        spark.conf.unset(key)
    counters = tables.newest_per_key(tables.read_batches(spark, f"{out.root}/counters"), ["severity", "dataset"])
    assert counters.agg(F.sum("events_total")).first()[0] == 400
    assert counters.filter("severity = 'unknown'").count() == 3
    assert tables.read_newest(spark, f"{out.root}/newest").count() == 150


def test_console_shows_a_bounded_number_of_rows(spark, bus, capsys):
    path, first = bus
    shown = {}
    to_console(5, shown.__setitem__)(first, 3)
    assert len(shown[3]) == 5
    finish(start_metrics(enrich(stream(spark, path, first.schema)), None, shared_dir(spark, "checkpoint"), **ONCE))
    assert "batch" in capsys.readouterr().out


def test_messages_survive_the_topic_folder(spark):
    df = events(spark, 50)
    root = shared_dir(spark, "topics")
    sent = raw_messages(df, 3, keep=[F.col("kafka_timestamp").alias("timestamp")])
    TopicTarget(folder=root).write(sent, "raw", 0)
    out = shared_dir(spark, "decoded")
    messages = topics.folder_stream(spark, f"{root}/raw/batch_id=0", "raw-events-(crimes|violence)")
    decoded = topics.decode_events(messages)
    finish(decoded.writeStream.foreachBatch(to_table(out)).option("checkpointLocation", shared_dir(spark, "checkpoint")).trigger(**ONCE).start())
    back = tables.read_batches(spark, out).select(*UNIFIED_COLUMNS)
    want = df.filter("source_dataset != 'arrests'").select(*UNIFIED_COLUMNS)
    assert Counter(map(tuple, back.collect())) == Counter(map(tuple, want.collect()))


def test_alert_reader_skips_broken_messages(spark):
    alerts = alert_messages(enrich(events(spark, 20)))
    broken = spark.createDataFrame([("t", "k", "{\"event_id\": "), ("t", "k", "[]"), ("t", "k", ""), ("t", "k", None), ("t", "k", "{}")], "topic string, key string, value string")
    parsed = topics.parse_alerts(alerts.unionByName(broken))
    assert parsed.count() == 20 and parsed.columns == ["topic", "key", *ALERT_COLUMNS]


def test_missing_table_reads_empty(spark):
    df = read_table(spark, shared_dir(spark, "none"), "hotspots")
    assert df.schema == TABLES["hotspots"] and df.count() == 0


def test_compacted_events_prune_and_spread(spark):
    df = enrich(events(spark, 300)).withColumn("processed_at", F.col("kafka_timestamp"))
    path = shared_dir(spark, "served")
    tables.compact_events(df, path, partitions=6)
    back = spark.read.parquet(path)
    assert back.count() == 300
    named = back.select("source_dataset", F.col("_metadata.file_name").alias("file"))
    per_dataset = named.groupBy("source_dataset").agg(F.countDistinct("file").alias("files"))
    assert all(r["files"] >= 2 for r in per_dataset.collect())
    text = back.filter("source_dataset = 'crimes'").select("event_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(source_dataset" in text


def test_versions_are_compacted_and_survive_a_repeated_batch(spark):
    path = shared_dir(spark, "versions")
    newest = {}
    for i in range(6):
        rows = [(f"k{j}", i * 10 + j) for j in range(i, 8)] + [(None, i)]
        newest |= dict(rows)
        tables.write_batch(spark.createDataFrame(rows, "k string, v int"), path, i)
        if i in (2, 3, 5):
            tables.compact_versions(spark, path, ["k"])
            left = sorted(p.name for p in Path(path.removeprefix("file:")).iterdir() if not p.name.startswith("."))
            assert left == ["_base", f"batch_id={i}"] and len([p for p in (Path(path.removeprefix("file:")) / "_base").iterdir()]) == 1
        tables.write_batch(spark.createDataFrame(rows, "k string, v int"), path, i)
        assert {r["k"]: r["v"] for r in tables.read_versions(spark, path, ["k"]).collect()} == newest
    tables.compact_versions(spark, path, ["k"])
    assert {r["k"]: r["v"] for r in tables.read_versions(spark, path, ["k"]).collect()} == newest
