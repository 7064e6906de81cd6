"""Detectors on the stream itself: silence by heartbeats, distinct counts by sketches, moments that merge."""

from __future__ import annotations

import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from beatwatch.operators import health, windows
from beatwatch.sinks.tables import read_batches, read_versions
from beatwatch.sources import topics
from beatwatch.streaming.batches import to_table
from beatwatch.streaming.queries import start_active, start_health

START = datetime(2024, 1, 1)
ONCE = {"availableNow": True}


def stored(spark, tmp_path, name, rows, schema):
    """A stream that takes one file of ``rows[i]`` a batch, in order."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return topics.replay(spark, str(tmp_path / name), spark.read.parquet(str(tmp_path / name)).schema, files_per_batch=1)


def test_a_feed_that_stops_is_reported(spark, tmp_path):
    """Crimes come for 20 minutes and stop; arrests go on; nobody sees a violence event."""
    at = lambda m, s=0: START + timedelta(minutes=m, seconds=s)
    minutes = [[m for m in range(0, 40) if m // 20 == part] for part in (0, 1)]
    events = [[("arrests", at(m, 7)) for m in part] + [("crimes", at(m, 9)) for m in part if m < 20] for part in minutes]
    stream = stored(spark, tmp_path, "events", events, "source_dataset string, processed_at timestamp")
    clock = stored(spark, tmp_path, "clock", [[(at(m),) for m in part] for part in minutes] + [[(at(60),)]], "timestamp timestamp")
    beats = health.heartbeats(clock, ["crimes", "arrests", "violence"])
    out = str(tmp_path / "out")
    start_health(stream, beats, out, str(tmp_path / "checkpoint"), minutes=5, **ONCE).awaitTermination()
    got = sorted((r["source_dataset"], (r["window_start"] - START).seconds // 60) for r in read_batches(spark, out).collect())
    assert got == [("crimes", m) for m in range(20, 40, 5)] + [("violence", m) for m in range(0, 40, 5)]


def test_slow_windows_and_batch_frames(spark):
    events = spark.createDataFrame([("crimes", START + timedelta(seconds=s)) for s in range(0, 300, 3)] + [("crimes", START + timedelta(seconds=301))], "source_dataset string, processed_at timestamp")
    clock = spark.createDataFrame([(START,), (START + timedelta(minutes=5),), (START + timedelta(minutes=10),)], "timestamp timestamp")
    rates = health.live_rates(events, health.heartbeats(clock, ["crimes", None]), 5)
    slow = {((r["window_start"] - START).seconds // 300, r["source_dataset"]): r["event_count"] for r in health.live_silence(rates, below=0.2).collect()}
    assert slow == {(1, "crimes"): 1, (2, "crimes"): 0, (0, None): 0, (1, None): 0, (2, None): 0}


def test_sketches_of_panes_count_windows(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.concat(F.lit("d"), (F.col("id") * 7919 % 20_000).cast("string")).alias("district"),
        F.timestamp_seconds(F.lit(int(START.timestamp())) + F.col("id") % 900).alias("processed_at"),
    )
    exact = {r["w"]: r["n"] for r in rows.groupBy(F.window("processed_at", "5 minutes", "1 minute")["start"].alias("w")).agg(F.countDistinct("district").alias("n")).collect()}
    got = {r["window_start"]: r["distinct_count"] for r in windows.distinct_windows(windows.distinct_panes(rows)).collect()}
    assert got.keys() == exact.keys()
    assert all(abs(got[w] / n - 1) < 4 * 0.0163 for w, n in exact.items())
    whole = rows.groupBy(F.window("processed_at", "5 minutes", "1 minute")["start"].alias("w")).agg(F.hll_sketch_estimate(F.hll_sketch_agg("district", 12)).alias("n"))
    assert {r["w"]: r["n"] for r in whole.collect()} == got


def test_active_districts_of_a_stream(spark, tmp_path):
    parts = [[(f"d{i % (4 + p)}" if i % 9 else "", START + timedelta(seconds=i)) for i in range(p * 100, p * 100 + 200)] for p in range(3)]
    stream = stored(spark, tmp_path, "events", parts, "district string, processed_at timestamp")
    out = str(tmp_path / "active")
    start_active(stream, out, str(tmp_path / "checkpoint"), **ONCE).awaitTermination()
    rows = [r for part in parts for r in part if r[0]]
    got = windows.distinct_windows(read_versions(spark, out, ["pane_start"])).collect()
    assert len(got) == 11
    for r in got:
        assert r["distinct_count"] == len({d for d, t in rows if r["window_start"] <= t < r["window_end"]})


def test_moments_of_large_values_with_a_small_spread(spark, tmp_path):
    draw = [1e9 + (i * 37 % 11) / 5 for i in range(400)]
    data = [("x", f"e{i}", v, START + timedelta(seconds=i)) for i, v in enumerate(draw)] + [("none", "n", None, START)]
    schema = "district string, event_id string, value double, processed_at timestamp"
    batch = windows.sliding_stats(spark.createDataFrame(data, schema), measure="value")
    out = str(tmp_path / "stats")
    live = windows.sliding_stats(stored(spark, tmp_path, "rows", [data], schema), measure="value")
    live.writeStream.outputMode("update").foreachBatch(to_table(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(**ONCE).start().awaitTermination()
    keyed = lambda df: {(r["district"], r["window_start"]): r for r in df.collect()}
    a, b = keyed(batch), keyed(read_batches(spark, out))
    assert a.keys() == b.keys() and len(a) > 15
    for k, r in a.items():
        inside = [v for d, _, v, t in data if d == k[0] and v is not None and r["window_start"] <= t < r["window_end"]]
        assert r["window_count"] == b[k]["window_count"] and r["max_severity"] == b[k]["max_severity"]
        if len(inside) > 1:
            assert abs(r["stddev_severity"] - statistics.stdev(inside)) < 1e-6 and abs(r["stddev_severity"] - b[k]["stddev_severity"]) < 1e-6
        else:
            assert r["stddev_severity"] is None and b[k]["stddev_severity"] is None
