"""Unique ids that another run repeats, and anomalies kept and sent once."""

from __future__ import annotations

import hashlib
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from beatwatch.operators import numbering
from beatwatch.plans import all_entries, ingest_job
from beatwatch.plans.ingest_queries import written_twice
from beatwatch.plans.registry import Tables
from beatwatch.schemas import RAW_COLUMNS
from beatwatch.sinks.tables import compact_versions, read_batches, read_versions
from beatwatch.sinks.topics import TopicTarget
from beatwatch.streaming.batches import ANOMALY_KEYS, Outputs, anomaly_fan_out


def test_equal_rows_are_numbered_in_chunks(spark, tmp_path):
    keys = ["hot"] * 700 + [f"k{i}" for i in range(300)] + ["twice"] * 2 + [None] * 3
    path = str(tmp_path / "keys")
    spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, v int").repartition(5).write.parquet(path)
    got = numbering.number_repeats(spark.read.parquet(path), "key", chunk_rows=20)
    assert got.columns == ["key", "v", "ordinal"]
    rows = got.collect()
    assert sorted(r["v"] for r in rows) == list(range(len(keys)))
    by: dict = {}
    for r in rows:
        by.setdefault(r["key"], []).append(r["ordinal"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and len(by["hot"]) == 700 and len(by[None]) == 3


def test_ids_depend_on_the_rows_alone(spark, tmp_path):
    rows = [("a", 1)] * 40 + [("b", 2), ("c", 3)]
    found = []
    for run, files in enumerate((1, 4)):
        path = str(tmp_path / f"run{run}")
        spark.createDataFrame(rows, "event_id string, v int").repartition(files).write.parquet(path)
        found.append(Counter(tuple(r) for r in numbering.unique_ids(spark.read.parquet(path), chunk_rows=7).collect()))
    assert found[0] == found[1] and max(found[0].values()) == 1
    assert {("a", 1), ("b", 2), ("c", 3)} < found[0].keys()


def shuffles(df):
    """Shuffles by key in the plan of a frame."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rows_are_shuffled_once_to_be_numbered(spark, tmp_path):
    ids = [f"{i % 500:064x}" for i in range(1000)] + ["K1", "0A", "0a", "", "0a", "K1", None, None]
    path = str(tmp_path / "ids")
    spark.createDataFrame([(k, i) for i, k in enumerate(ids)], "event_id string, v int").repartition(3).write.parquet(path)
    got = numbering.unique_ids(spark.read.parquet(path))
    assert got.columns == ["event_id", "v"] and shuffles(got) == 1
    rows = got.collect()
    assert sorted(r["v"] for r in rows) == list(range(len(ids)))
    by: dict = {}
    for r in rows:
        by.setdefault(ids[r["v"]], []).append(r["event_id"])
    for key, own in by.items():
        text = "" if key is None else key + "\x1f"
        assert sorted(map(str, own)) == sorted(str(key) if k == 0 else hashlib.sha256(f"{text}{k}".encode()).hexdigest() for k in range(len(own)))


def test_hot_keys_are_numbered_beside_others(spark, tmp_path):
    """Several hot keys, one null, that share large buckets with keys of few rows; copies lie in all files."""
    keys = ([None] * 90 + ["a"] * 130 + ["b"] * 61 + [f"k{i}" for i in range(80)]) * 2
    path = str(tmp_path / "keys")
    spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, v int").repartition(4).write.parquet(path)
    for chunk_rows in (5, 60, 1 << 16):
        rows = numbering.number_repeats(spark.read.parquet(path), "key", chunk_rows).collect()
        assert sorted(r["v"] for r in rows) == list(range(len(keys)))
        assert Counter((r["key"], r["ordinal"]) for r in rows) == Counter((k, i) for k, n in Counter(keys).items() for i in range(n))


def test_rows_written_twice_stay_where_they_are(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    rows = spark.range(1000).selectExpr("id", "cast(id % 7 as string) AS v")
    dealt = []
    for files in (3, 5):
        twice = written_twice(tables, rows.coalesce(1), files)
        assert sorted(r["id"] for r in twice.collect()) == sorted([*range(1000)] * 2)
        found = twice.inputFiles()
        assert len(found) >= files and all(f.endswith(".zstd.parquet") for f in found)
        dealt.append(Counter(r["n"] for r in twice.groupBy("_metadata.file_path").agg(F.count("*").alias("n")).collect()))
    assert dealt[0] != dealt[1]


def test_ids_of_two_runs_meet_in_one_shuffle(spark):
    got = all_entries()["nrm8b"](spark, "/root/testdata/sf0.001")
    assert shuffles(got) == 3  # each run is numbered in one


def test_messages_in_files_are_packed(spark, tmp_path):
    rows = spark.range(20000).select(F.lit("t").alias("topic"), F.sha2(F.col("id").cast("string"), 256).alias("key"), F.lit("v").alias("value"))
    target = TopicTarget(folder=str(tmp_path))
    target.write(rows.coalesce(1), "raw", 0)
    target.write(rows.coalesce(1), "raw", 0)  # a repeated batch replaces itself
    assert read_batches(spark, f"{tmp_path}/raw").select("key").distinct().count() == 20000
    # 64 hex digits hold 32 bytes
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 20000 * 50


def test_two_runs_of_the_producer_send_the_same_keys(spark, tmp_path):
    for dataset, name in {"crimes": "Crimes", "arrests": "Arrests", "violence": "Violence", "sex-offenders": "Sex Offenders"}.items():
        names = list(RAW_COLUMNS[dataset])
        line = ",".join(str(i) for i in range(len(names)))
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(names), line, line, line, line.replace("0", "9", 1), line, "too,short"]))
    keys = []
    for run, files in enumerate((1, 3)):
        bus = str(tmp_path / f"bus{run}")
        counts = ingest_job.publish(spark, str(tmp_path), str(tmp_path / f"landing{run}"), TopicTarget(folder=bus), partitions=files).collect()
        assert {(r["read"], r["malformed"], r["published"]) for r in counts} == {(6, 1, 5)}
        keys.append(sorted(r["key"] for r in read_batches(spark, f"{bus}/raw").collect()))
    assert keys[0] == keys[1] and len(set(keys[0])) == len(keys[0]) == 20


def volume_batch(spark, counts):
    """Anomalies of one batch: window number to count."""
    level = lambda n: "CRITICAL" if n > 30 else "HIGH" if n > 20 else "MEDIUM"
    rows = [
        ("crimes", None if w == 9 else "001", datetime(2024, 1, 1, w), datetime(2024, 1, 1, w, 5), n, None, None, 10, datetime(2024, 2, 1), level(n))
        for w, n in counts.items()
    ]
    return spark.createDataFrame(
        rows,
        """source_dataset string, district string, window_start timestamp, window_end timestamp, event_count long, window_first_event timestamp,
        window_last_event timestamp, threshold int, detected_at timestamp, alert_severity string""",
    )


def test_a_window_is_stored_once_and_sent_once_for_each_level(spark, tmp_path):
    out = Outputs(str(tmp_path), TopicTarget(folder=f"{tmp_path}/topics"))
    body = anomaly_fan_out(out, "volume")
    table, keys = f"{out.root}/volume_alerts", ANOMALY_KEYS["volume"]
    batches = [{1: 11, 2: 15, 9: 12}, {1: 14, 2: 25, 3: 40}, {1: 35, 9: 13}]
    body(volume_batch(spark, batches[0]), 0)
    body(volume_batch(spark, batches[1]), 1)
    body(volume_batch(spark, batches[1]), 1)  # repeated after a failure
    compact_versions(spark, table, keys)
    body(volume_batch(spark, batches[1]), 1)  # and once more after a compaction
    body(volume_batch(spark, batches[2]), 2)
    body(volume_batch(spark, batches[2]), 2)
    now = {r["window_start"].hour: r["event_count"] for r in read_versions(spark, table, keys).collect()}
    assert now == {1: 35, 2: 25, 3: 40, 9: 13}
    sent = read_batches(spark, f"{out.root}/topics/volume").select("batch_id", F.get_json_object("value", "$.window_start").substr(12, 2).cast("int").alias("w"), F.get_json_object("value", "$.alert_severity").alias("level"))
    want = [(0, 1, "MEDIUM"), (0, 2, "MEDIUM"), (0, 9, "MEDIUM"), (1, 2, "HIGH"), (1, 3, "CRITICAL"), (2, 1, "CRITICAL")]
    assert sorted(map(tuple, sent.collect())) == want
    assert read_batches(spark, f"{out.root}/volume_log", form="json").count() == len(want)


def test_a_zscore_window_is_sent_once(spark, tmp_path):
    out = Outputs(str(tmp_path), TopicTarget(folder=f"{tmp_path}/topics"))
    body = anomaly_fan_out(out, "zscore")
    row = lambda n: spark.createDataFrame(
        [("001", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 2), n, 1.0, 0.5, 5, 8.0)],
        "district string, window_start timestamp, window_end timestamp, window_count long, mean_severity double, stddev_severity double, max_severity int, z_score double",
    )
    for batch_id, n in enumerate((5, 6, 9)):
        body(row(n), batch_id)
    assert [r["window_count"] for r in read_versions(spark, f"{out.root}/zscore_alerts", ANOMALY_KEYS["zscore"]).collect()] == [9]
    assert read_batches(spark, f"{out.root}/topics/zscore").count() == 1
