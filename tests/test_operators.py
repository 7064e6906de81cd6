"""Batch operators against hand-made rows and brute force, with one key holding a third of the rows."""

from __future__ import annotations

import hashlib
import math
import statistics
from collections import Counter
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from beatwatch.operators import (
    correlate,
    enrich,
    geo,
    health,
    hotspots,
    joins,
    limits,
    offenders,
    paging,
    rates,
    summaries,
    trends,
    violence,
    windows,
)
from beatwatch.schemas import TABLES, conform

START = datetime(2024, 1, 1)


def tuples(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


# Joins and dedup ---------------------------------------------------------------------------


def skewed_cases(spark, n=3000):
    """A third of the rows share one case, a tenth have no case."""
    rows = [("hot" if i % 3 == 0 else None if i % 10 == 1 else f"c{i % 400}", i) for i in range(n)]
    return spark.createDataFrame(rows, "case_number string, i int").repartition(6), rows


def test_one_per_key_is_the_smallest_whatever_the_order(spark):
    rows = [("a", "2", "x"), ("a", "1", "z"), ("a", "1", "y"), ("b", None, "q"), (None, "3", "n")]
    for shuffled in (rows, rows[::-1]):
        got = joins.one_per_key(spark.createDataFrame(shuffled, "k string, o string, v string"), "k", ["o"])
        assert sorted(tuples(got), key=str) == sorted([("a", "1", "y"), ("b", None, "q"), (None, "3", "n")], key=str)


def test_heavy_keys_are_few_and_found(spark):
    df, _ = skewed_cases(spark)
    assert [r[0] for r in joins.heavy_keys(df, "case_number", share=0.2).collect()] == ["hot"]


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_left_join_one_keeps_every_row_once(spark, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        df, rows = skewed_cases(spark)
        races = {"hot": "H", **{f"c{i}": f"r{i}" for i in range(0, 400, 2)}}
        right = spark.createDataFrame([*races.items(), (None, "never")], "case_number string, race string")
        got = joins.left_join_one(df, right, "case_number")
        assert got.columns == ["case_number", "i", "race"]
        assert Counter(tuples(got)) == Counter((c, i, races.get(c)) for c, i in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_key_is_dealt_over_partitions(spark):
    df, _ = skewed_cases(spark)
    right = spark.createDataFrame([("hot", "H")], "case_number string, race string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.left_join_one(df, right, "case_number")
        parts = joined.filter("case_number = 'hot'").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rate_needs_enough_rows(spark):
    rows = [("a", "true")] * 100 + [("b", "true")] * 99 + [("c", " YES ")] * 25 + [("c", None)] * 75 + [(None, "1")] * 100
    top = rates.top_arrest_rates(spark.createDataFrame(rows, "primary_type string, arrest string"))
    assert tuples(top) == [(None, 100, 100, 1.0), ("a", 100, 100, 1.0), ("c", 100, 25, 0.25)]


# Caps --------------------------------------------------------------------------------------


def digest(key):
    return hashlib.md5(str(key).encode()).hexdigest()


@pytest.mark.parametrize(("n", "total", "digits"), [(50, None, 1), (50, 120, 1), (7, 20, 2), (10_000, None, 1), (10_000, 500, 2), (3, 1, 1)])
def test_cap_rows_matches_ranking_everything(spark, n, total, digits):
    rows = [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"g{i % 5}", i) for i in range(1500)]
    got = limits.cap_rows(spark.createDataFrame(rows, "g string, k int"), "g", "k", n, total, digits)
    ordered = sorted(rows, key=lambda r: digest(r[1]))
    seen, want = Counter(), []
    for group, key in ordered:
        seen[group] += 1
        if seen[group] <= n:
            want.append((group, key))
    assert Counter(tuples(got)) == Counter(want[:total])


# Pages -------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["string", "bigint"])
def test_deep_page_matches_a_full_sort(spark, monkeypatch, kind):
    monkeypatch.setattr(paging, "LEFT_ROWS", 40)
    # a third of all rows carry the same instant; some have none
    times = [START if i % 3 == 0 else None if i % 50 == 1 else START + timedelta(hours=i % 60, microseconds=i) for i in range(1200)]
    rows = [(i * 7919 % 1200 if kind == "bigint" else hashlib.sha256(str(i).encode()).hexdigest(), t) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, f"event_id {kind}, processed_at timestamp")
    want = sorted(rows, key=lambda r: r[0])
    want.sort(key=lambda r: (r[1] is not None, r[1] or START), reverse=True)
    for skip in (0, 39, 60, 555, 790, 800, 1170, 1199, 1500):
        assert tuples(paging.deep_page(df, skip, 25)) == want[skip : skip + 25], skip


def test_history_parameters(spark):
    rows = [(f"{i:03d}", "a" if i % 2 else "b", START + timedelta(seconds=i)) for i in range(120)]
    df = spark.createDataFrame(rows, "event_id string, source_dataset string, processed_at timestamp")
    assert paging.event_history(df).count() == 50
    assert paging.event_history(df, limit=501).count() == 50
    assert paging.event_history(df, limit=500).count() == 120
    assert paging.recent_alerts(df, limit=0).count() == 20
    assert tuples(paging.event_history(df, "a", 2, 1), "event_id") == [("117",), ("115",)]
    assert [paging.replay_offset(v, 1050) for v in (100, 50, 0)] == [0, 500, 1000]
    assert paging.replay_offset(50, 51) == 1  # halves round up
    assert paging.replay_offset(0, 10) == 0
    assert tuples(paging.replay_page(df, 0, paging.order_index(df)), "event_id")[-1] == ("000",)


# Summaries ---------------------------------------------------------------------------------


def gold(spark, rows):
    return spark.createDataFrame(rows, "event_id string, source_dataset string, district string, severity int, processed_at timestamp")


def test_null_and_unknown_stay_apart(spark):
    df = gold(spark, [("1", None, "1", None, START), ("2", "unknown", None, 1, START), ("3", "a", "1", 5, START)])
    assert sorted(tuples(summaries.dataset_summary(df), "dataset", "total_events")) == [("a", 1), ("unknown", 1), ("unknown", 1)]
    assert sorted(tuples(summaries.severity_histogram(df))) == [(1, 1), (1, 1), (5, 1)]
    assert tuples(summaries.district_summary(df), "district", "total_events", "avg_severity", "critical_count") == [("1", 2, 5.0, 1)]


def test_severity_shares(spark):
    df = gold(spark, [(str(i), "a", "1", s, START) for i, s in enumerate([1, 5, 5, None, None, None])])
    assert tuples(summaries.severity_shares(df)) == [(1, 1, 33.33), (2, 0, 0.0), (3, 0, 0.0), (4, 0, 0.0), (5, 2, 66.67)]
    only_null = df.filter("severity is null")
    assert tuples(summaries.severity_shares(only_null))[0] == (1, 3, 100.0)
    nothing = df.filter("false")
    assert [r[1] for r in tuples(summaries.severity_shares(nothing))] == [0] * 5
    assert [r[1] for r in tuples(summaries.severity_shares(nothing, live=df))] == [1, 0, 0, 0, 2]
    assert [r[1] for r in tuples(summaries.severity_shares(df, live=df))] == [1, 0, 0, 0, 2]


def test_recent_counts_and_clamp(spark):
    now = START + timedelta(hours=2)
    df = gold(spark, [(str(i), "a", d, 4, now - timedelta(seconds=s)) for i, (d, s) in enumerate([("1", 0), ("1", 59), ("", 60), ("2", 200), (None, 10), ("3", 300)])])
    assert tuples(summaries.recent_count(df, now)) == [(3,)]
    assert tuples(summaries.active_districts(df, now)) == [(2,)]
    assert [summaries.clamp(h, 168, 24) for h in (None, 0, 1, 168, 169)] == [24, 24, 1, 168, 24]
    assert summaries.hourly_trend(df, now, 1).count() == 2
    assert tuples(summaries.critical_in_buffer(df, 4)) == [(4,)]


def test_intensity_and_centroids(spark):
    df = spark.createDataFrame([("1", 10), ("013", 5), ("25", 0)], "district string, total_events bigint")
    assert sorted(tuples(summaries.intensity(df), "intensity")) == [(0.0,), (0.5,), (1.0,)]
    located = geo.locate_districts(df)  # there is no district 13
    assert sorted(tuples(located, "district_key", "centre_lat")) == [("001", 41.8827), ("025", 41.9055)]
    assert len(geo.DISTRICT_CENTROIDS) == 22


# Trends, violence, offenders, correlations -------------------------------------------------------


def test_bad_dates_form_a_null_group(spark):
    df = spark.createDataFrame([("05/02/2026 11:49:00 PM",), ("junk",), (None,), ("05/02/2026",)], "date string")
    got = tuples(conform(trends.crime_trends(df), "crime_trends"))
    assert sorted(got, key=str) == sorted([(2026, 5, 7, 23, 1), (None, None, None, None, 3)], key=str)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.none() | st.integers(-1, 14), st.integers(0, 9)), max_size=20))
def test_densify_always_has_every_month(spark, rows):
    got = tuples(trends.densify(spark.createDataFrame(rows, "month int, n bigint"), "month", 12, ["n"]))
    assert got == [(m, sum(n for k, n in rows if k == m)) for m in range(1, 13)]


def violence_rows(spark, rows):
    return spark.createDataFrame(rows, "date string, month string, district string, community_area string, victimization_primary string, incident_primary string, gunshot_injury string")


def test_violence_analysis(spark):
    df = violence_rows(
        spark,
        [
            ("05/02/2026 01:00:00 AM", "7", "011", "A", "HOMICIDE", None, "YES"),
            ("05/02/2026 01:00:00 AM", "x", "011", " ", "BATTERY", "Homicide", None),
            ("05/02/2026 01:00:00 AM", None, "011", None, None, None, " yes "),
        ],
    )
    got = tuples(conform(violence.violence_analysis(df), "violence_analysis"))
    assert sorted(got) == [(5, "011", 1, 1, 1, 2, 0.6667), (7, "011", 1, 0, 1, 1, 0.6667)]
    assert tuples(violence.gunshot_share(violence.violence_flags(df.filter("false")))) == [(0.0,)]
    assert tuples(violence.top_communities(df)) == [("A", 1)]
    months = tuples(violence.violence_by_month(violence.violence_analysis(df)))
    assert len(months) == 12 and months[4] == (5, 1, 1, 0.6667) and months[0] == (1, 0, 0, 0.6667)


def test_offender_tables(spark):
    df = spark.createDataFrame(
        [("LEE", " ANN ", "B", "F", "WHITE", " y "), ("ROE", None, "B", "M", "", None)],
        "last string, first string, block string, gender string, race string, victim_minor string",
    )
    flagged = conform(offenders.offender_flags(df), "sex_offender_proximity")
    assert sorted(tuples(flagged, "offender_name", "priority_flag")) == [("ANN LEE", "PRIORITY"), ("ROE", "STANDARD")]
    assert tuples(offenders.by_race(flagged)) == [("WHITE", 1)]
    stations = spark.createDataFrame([("1", "C", "A", "41.5", "bad")], "district string, district_name string, address string, latitude string, longitude string")
    density = conform(offenders.offender_density(stations, flagged), "district_offender_density")
    assert tuples(density) == [("1", "C", "A", 41.5, None, 2, 1)]


def test_districts_meet_as_numbers(spark):
    crimes = spark.createDataFrame([("11", "C", "true"), ("011", " ", "no"), ("N/A", None, None)], "district string, community_area string, arrest string")
    victims = spark.createDataFrame([("011",), ("11",), ("",)], "district string")
    table = conform(correlate.correlations(crimes, victims, victims), "correlations")
    rows = {r["group_key"] or r["community_area"]: r for r in table.collect()}
    assert rows["11"]["total_crimes"] == 2 and rows["11"]["metric_a"] == 0.5 and rows["11"]["metric_b"] == 1.0
    assert rows["C"]["sex_offender_count"] == 3 and rows["C"]["metric_a"] == 1.0
    assert rows[None]["total_crimes"] == 1 and rows[None]["violence_incidents"] is None
    assert table.schema["group_key"].dataType == TABLES["correlations"]["group_key"].dataType


def test_contract_violations_are_reported(spark):
    with pytest.raises(ValueError, match="crime_count"):
        conform(spark.range(1).select(*[F.lit(1).alias(c) for c in TABLES["crime_trends"].fieldNames()]), "crime_trends")


# Windows and anomalies ---------------------------------------------------------------------------


def scored(spark, severities):
    df = gold(spark, [(str(i), "a", "1", s, START + timedelta(seconds=i)) for i, s in enumerate(severities)])
    return windows.score(windows.sliding_stats(df, size="1 minute", slide="1 minute")).collect()


def test_zscore_needs_six_samples(spark):
    (row,) = scored(spark, [3, 3, 3, 3, 3, 5])
    assert round(row["z_score"], 2) == 2.04
    assert scored(spark, [3, 3, 3, 3, 5]) == []
    assert scored(spark, [4, 4, 4]) == []  # no deviation at all, but more than one event


def test_a_lone_high_event_is_an_anomaly(spark):
    (row,) = scored(spark, [4])
    assert (row["stddev_severity"], row["z_score"]) == (None, 0.0)
    assert scored(spark, [3]) == []
    assert scored(spark, [None]) == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.none() | st.integers(1, 5), min_size=1, max_size=40))
def test_pane_statistics_match_the_definition(spark, severities):
    df = gold(spark, [(str(i), "a", "1", s, START + timedelta(seconds=13 * i)) for i, s in enumerate(severities)])
    for r in windows.sliding_stats(df).collect():
        inside = [s for i, s in enumerate(severities) if r["window_start"] <= START + timedelta(seconds=13 * i) < r["window_end"]]
        known = [s for s in inside if s is not None]
        assert r["window_count"] == len(inside)
        assert r["max_severity"] == (max(known) if known else None)
        assert r["mean_severity"] is None if not known else math.isclose(r["mean_severity"], statistics.mean(known))
        if len(known) < 2:
            assert r["stddev_severity"] is None
            continue
        assert math.isclose(r["stddev_severity"], statistics.stdev(known), abs_tol=1e-9)
        if r["stddev_severity"] > 0:  # the largest z of n samples is (n - 1) / sqrt(n)
            z = (r["max_severity"] - r["mean_severity"]) / r["stddev_severity"]
            assert z <= (len(known) - 1) / math.sqrt(len(known)) + 1e-9


def test_panes_equal_native_sliding_windows(spark):
    rows = [(str(i), "hot" if i % 3 == 0 else f"d{i % 4}", i % 5 + 1, START + timedelta(seconds=17 * i)) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id string, district string, severity int, processed_at timestamp")
    exact = windows.sliding_stats(df)
    x = df.groupBy(F.window("processed_at", "2 minutes", "30 seconds").alias("w"), "district").agg(
        F.count("event_id").alias("window_count"), F.avg("severity").alias("mean_severity"), F.stddev("severity").alias("stddev_severity"), F.max("severity").alias("max_severity")
    )
    native = x.withColumn("window_start", F.col("w.start"))
    shown = ["district", "window_start", "window_count", *[F.round(c, 9) for c in ("mean_severity", "stddev_severity", "max_severity")]]
    assert Counter(tuples(exact, *shown)) == Counter(tuples(native, *shown))


@pytest.mark.parametrize(("size", "slide"), [("2 minutes", "45 seconds"), ("70 seconds", "1 minute"), ("5 minutes", "1 minute")])
def test_panes_fit_any_size_and_slide(spark, size, slide):
    rows = [("a", "1", START + timedelta(seconds=10 * i)) for i in range(90)]
    df = spark.createDataFrame(rows, "source_dataset string, district string, event_time timestamp").withColumn("kafka_timestamp", F.col("event_time"))
    got = windows.volume_windows(df, size=size, slide=slide)
    native = df.groupBy(F.window("event_time", size, slide).alias("w")).count()
    assert Counter(tuples(got, "window_start", "event_count")) == Counter(tuples(native, "w.start", "count"))


@pytest.mark.parametrize(("count", "level"), [(50, None), (51, "MEDIUM"), (100, "MEDIUM"), (101, "HIGH"), (150, "HIGH"), (151, "CRITICAL")])
def test_volume_thresholds(spark, count, level):
    df = spark.range(count).select(
        F.lit("a").alias("source_dataset"),
        F.lit("1").alias("district"),
        F.timestamp_seconds(F.lit(1_700_000_100)).alias("event_time"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("kafka_timestamp"),
    )
    found = conform(windows.volume_anomalies(windows.volume_windows(df)), "alerts").collect()
    assert [r["alert_severity"] for r in found] == ([level] * 5 if level else [])
    assert all(r["window_last_event"] - r["window_first_event"] == timedelta(seconds=count - 1) for r in found)


def test_health_finds_silence(spark):
    seconds = [30, 40, 130, 700]
    df = gold(spark, [(str(i), "a" if i else None, "1", 1, START + timedelta(seconds=s)) for i, s in enumerate(seconds)])
    silent = [r["window_start"] for r in health.no_events(df, minutes=2).collect()]
    assert sorted(silent) == [START + timedelta(minutes=m) for m in (4, 6, 8)]
    quiet = {(r["source_dataset"], r["window_start"].minute) for r in health.silent_datasets(df).collect()}
    # the windows that the first and the last event cut are not judged
    assert quiet == {(None, 5), ("a", 5)}
    assert health.low_rate(df).count() == 1


def test_health_sees_an_ongoing_outage(spark):
    df = gold(spark, [("1", "a", "1", 1, START), ("2", "a", "1", 1, START + timedelta(seconds=130))])
    now = START + timedelta(minutes=11)
    assert health.no_events(df, minutes=2).count() == 0
    silent = sorted(r["window_start"] for r in health.no_events(df, minutes=2, as_of=now).collect())
    assert silent == [START + timedelta(minutes=m) for m in (4, 6, 8)]
    late = sorted(r["window_start"] for r in health.no_events(df, minutes=2, as_of=now, hold=3).collect())
    assert late == [START + timedelta(minutes=m) for m in (6, 8)]
    assert health.no_events(df.limit(0), minutes=2, as_of=now).count() == 0


# Enrichment and clustering ------------------------------------------------------------------------


def test_validity_reasons(spark):
    df = spark.createDataFrame([("d", "1"), ("", "1"), ("d", None), (None, ""), ("unknown", " ")], "incident_date string, district string")
    assert sorted(tuples(enrich.valid_events(df))) == [("d", "1"), ("unknown", " ")]
    reasons = Counter(tuples(enrich.malformed_events(df), "invalid_reason"))
    assert reasons == {("missing_incident_date",): 1, ("missing_district",): 1, ("missing_incident_date,missing_district",): 1}


def test_kmeans_assigns_to_the_nearest_centre(spark):
    rows = [("T" + str(i % 2), str(41 + i % 4 + i % 7 / 100), str(-87 - i % 4)) for i in range(200)] + [("bad", "x", "1"), ("none", None, "")]
    points = enrich.with_coordinates(spark.createDataFrame(rows, "primary_type string, latitude string, longitude string"))
    assert points.count() == 200
    model = hotspots.fit_hotspots(points, k=4)
    centres = {r[0]: (r[1], r[2]) for r in hotspots.centroid_table(points, model).collect()}
    for r in hotspots.assign_clusters(points, model).collect():
        near = min(centres, key=lambda c: math.dist(centres[c], (r["latitude"], r["longitude"])))
        assert math.isclose(math.dist(centres[near], (r["latitude"], r["longitude"])), math.dist(centres[r["cluster_id"]], (r["latitude"], r["longitude"])), abs_tol=1e-9)
    table = conform(hotspots.with_centroids(hotspots.cluster_stats(hotspots.assign_clusters(points, model)), hotspots.centroid_table(points, model)), "hotspots")
    assert sum(r["crime_count"] for r in table.collect()) == 200
    assert {r["primary_types"] for r in table.collect()} <= {"T0", "T1", "T0, T1"}
