"""Registered queries: the same events replayed as a stream, through sinks and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from beatwatch.functions.ids import content_id
from beatwatch.operators import trends, windows
from beatwatch.operators.enrich import alerts_only, enrich, valid_events, with_event_time
from beatwatch.operators.health import heartbeats
from beatwatch.operators.normalise import crime_events, offender_events
from beatwatch.operators.numbering import unique_ids
from beatwatch.operators.summaries import critical_in_buffer, dataset_summary, topic_counters
from beatwatch.plans.batch_queries import TRENDS
from beatwatch.plans.ingest_queries import EVENTS_SQL, GOLD_EVENT, wire, written_twice
from beatwatch.plans.registry import Tables, register
from beatwatch.plans.serving_queries import ANOMALIES, AS_OF, CENTS, CITY_VOLUME, MEASURES, STATS, STATS_SHOWN, VOLUME, grid, in_cents, rounded, slid
from beatwatch.plans.shapes import shape
from beatwatch.plans.stream_app import start_all
from beatwatch.schemas import ALERT_MESSAGE, TABLES, UNIFIED_COLUMNS, conform
from beatwatch.session import state_partitions
from beatwatch.sinks.tables import compact_versions, newest_per_key, overwrite_table, read_batches, read_newest, read_versions, write_batch, write_documents
from beatwatch.sinks.topics import TopicTarget, on_topic, raw_messages
from beatwatch.sources import topics
from beatwatch.sources.tables import read_table
from beatwatch.streaming.batches import ANOMALY_KEYS, Outputs, to_table
from beatwatch.streaming.queries import start_active, start_buffer, start_counters, start_health, start_main, start_malformed, start_metrics, start_volume, start_zscore

ONCE = {"availableNow": True}


def stream_of(t: Tables, table: str, name: str) -> DataFrame:
    """A given table replayed as a stream, in a shape, with zoned times."""
    source = topics.replay(t.spark, f"{t.sf_dir}/{table}.parquet", t.raw(table).schema)
    rows = shape(t.spark, t.sf_dir, name, source)
    return rows.select(*[F.col(c).cast("timestamp").alias(c) if k == "timestamp_ntz" else F.col(c) for c, k in rows.dtypes])


def gold_stream(t: Tables) -> DataFrame:
    return stream_of(t, "events", "gold")


def crime_content(gold: DataFrame) -> DataFrame:
    """Unified events with ids of their content."""
    return gold.select(content_id("event_id", "incident_date", "crime_type").alias("event_id"), *UNIFIED_COLUMNS[1:])


def drain(*queries: StreamingQuery) -> None:
    """Wait until everything available was processed; a failed query raises."""
    for query in queries:
        query.awaitTermination()


def outputs(t: Tables, label: str) -> Outputs:
    root = t.work_dir(label)
    return Outputs(root, TopicTarget(folder=f"{root}/topics"))


ENRICHED = f"""SELECT {GOLD_EVENT}, kafka_timestamp, severity >= 3 AS is_alert,
  CASE WHEN crime_type <> '' THEN crime_type ELSE injury_type END AS event_label FROM gold"""
ALERTS = f"SELECT {GOLD_EVENT}, event_label, 'alerts-' || coalesce(source_dataset, 'unknown') AS topic FROM ({ENRICHED}) WHERE severity >= 3"
DISTRICT_WINDOWS = """SELECT time_bucket(INTERVAL 10 SECONDS, processed_at, TIMESTAMP '1970-01-01') AS window_start,
  time_bucket(INTERVAL 10 SECONDS, processed_at, TIMESTAMP '1970-01-01') + INTERVAL 10 SECONDS AS window_end, district,
  count(event_id) AS event_count, avg(severity) AS avg_severity,
  CAST(sum(CASE WHEN severity >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS critical_count FROM gold GROUP BY 1, 2, 3"""
COUNTERS = """SELECT coalesce(CAST(severity AS VARCHAR), 'unknown') AS severity, coalesce(source_dataset, 'unknown') AS dataset, count(*) AS events_total
FROM gold GROUP BY 1, 2"""
MALFORMED = """SELECT event_id, CASE WHEN incident_date = '' AND coalesce(district, '') = '' THEN 'missing_incident_date,missing_district'
  WHEN incident_date = '' THEN 'missing_incident_date' ELSE 'missing_district' END AS invalid_reason
FROM gold WHERE incident_date = '' OR coalesce(district, '') = ''"""
HOURS = {"size": "6 hours", "slide": "3 hours", "watermark": "30 seconds"}


SILENT_EXPECTED = grid(5, True, "event_count = 0", 5)


@register("str14d", f"WITH {SILENT_EXPECTED}", "gold")
def _(t: Tables) -> DataFrame:
    """Silent windows found in the stream itself: events and the heartbeats of a clock up to the given time."""
    expected = [r[0] for r in t.gold.select("source_dataset").distinct().collect()]
    ticks = t.work_dir("ticks")
    first = t.gold.agg(F.ceil(F.unix_timestamp(F.min("processed_at").cast("timestamp")) / 300) * 300).first()[0]
    end = F.unix_timestamp(F.lit(AS_OF).cast("timestamp"))
    # a tick for each whole window, and one later on that lets the last of them end
    times = F.concat(F.sequence(F.lit(first).cast("long"), end - 300, F.lit(300).cast("long")), F.array(end + 3600))
    t.spark.range(1).select(F.explode(times).alias("s")).select(F.timestamp_seconds("s").alias("timestamp")).write.parquet(ticks)
    clock = topics.replay(t.spark, ticks, t.spark.read.parquet(ticks).schema)
    out = t.work_dir("silence")
    with state_partitions(t.spark):
        drain(start_health(gold_stream(t), heartbeats(clock, expected), out, t.work_dir("checkpoint"), **ONCE))
    return read_batches(t.spark, out).drop("batch_id")


ACTIVE = slid("known", "processed_at", 5, 1)


@register(
    "agg25b",
    f"""WITH known AS (SELECT district, processed_at FROM gold WHERE district <> ''), {ACTIVE}
SELECT window_start, window_end, count(DISTINCT district) AS distinct_count FROM slid GROUP BY 1, 2""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    """Active districts of every five minutes, from the sketches that a stream keeps by minute."""
    out = t.work_dir("active")
    with state_partitions(t.spark):
        drain(start_active(gold_stream(t), out, t.work_dir("checkpoint"), **ONCE))
    return windows.distinct_windows(read_versions(t.spark, out, ["pane_start"]))


# Sources --------------------------------------------------------------------------------------


@register("src6", f"SELECT kafka_timestamp, {GOLD_EVENT} FROM gold WHERE source_dataset IN ('crimes', 'arrests')", "gold")
def _(t: Tables) -> DataFrame:
    root = t.work_dir("bus")
    TopicTarget(folder=root).write(wire(t), "raw", 0)
    messages = topics.folder_stream(t.spark, f"{root}/raw/batch_id=0", "raw-events-(crimes|arrests)")
    out = t.work_dir("decoded")
    with state_partitions(t.spark):
        events = topics.decode_events(messages)
        drain(
            events.writeStream.foreachBatch(to_table(out))
            .option("checkpointLocation", t.work_dir("checkpoint"))
            .trigger(**ONCE)
            .start()
        )
    return read_batches(t.spark, out).drop("batch_id")


@register("src9", f"WITH {TRENDS} SELECT * FROM trends WHERE year = 1999", "crimes")
def _(t: Tables) -> DataFrame:
    root = t.work_dir("tables")
    overwrite_table(trends.crime_trends(t.crimes), root, "crime_trends")
    return read_table(t.spark, root, "crime_trends").filter("year = 1999")


@register("src11", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    out = t.work_dir("replayed")
    stream = topics.replay(t.spark, f"{t.sf_dir}/events.parquet", t.raw("events").schema)
    drain(stream.writeStream.foreachBatch(to_table(out)).option("checkpointLocation", t.work_dir("checkpoint")).trigger(**ONCE).start())
    return read_batches(t.spark, out).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@register("set2", f"SELECT * FROM ({EVENTS_SQL['crimes']}\nUNION ALL\n{EVENTS_SQL['offenders']})", "crimes offenders")
def _(t: Tables) -> DataFrame:
    """Two streams, normalised and united into one."""
    crimes = crime_events(stream_of(t, "orders", "crimes"))
    both = crimes.unionByName(offender_events(stream_of(t, "customer", "offenders")))
    out = t.work_dir("united")
    drain(both.writeStream.foreachBatch(to_table(out)).option("checkpointLocation", t.work_dir("checkpoint")).trigger(**ONCE).start())
    return read_batches(t.spark, out).drop("batch_id", "processed_timestamp")


# Streaming operators ---------------------------------------------------------------------------


def _main(t: Tables, label: str) -> Outputs:
    """Enrich and fan out the whole event stream."""
    out = outputs(t, label)
    drain(start_main(enrich(gold_stream(t).drop("processed_at", "value")), out, t.work_dir("checkpoint"), **ONCE))
    return out


@register("str1", ENRICHED, "gold")
def _(t: Tables) -> DataFrame:
    out = _main(t, "fanout")
    return read_batches(t.spark, f"{out.root}/events").drop("batch_id", "processed_at", "received_lag_ms")


@register("str2", DISTRICT_WINDOWS, "gold")
def _(t: Tables) -> DataFrame:
    out = t.work_dir("metrics")
    with state_partitions(t.spark):
        drain(start_metrics(gold_stream(t), out, t.work_dir("checkpoint"), **ONCE))
    return newest_per_key(read_batches(t.spark, out), ["window_start", "window_end", "district"])


@register("str3", f"WITH src AS (SELECT *, severity AS m FROM gold), {slid('src', 'processed_at', 360, 180)}, {STATS} SELECT {STATS_SHOWN} FROM stats", "gold")
def _(t: Tables) -> DataFrame:
    out = t.work_dir("stats")
    with state_partitions(t.spark):
        stats = windows.sliding_stats(gold_stream(t), **HOURS)
        drain(
            stats.writeStream.outputMode("update")
            .foreachBatch(to_table(out))
            .option("checkpointLocation", t.work_dir("checkpoint"))
            .trigger(**ONCE)
            .start()
        )
    return rounded(newest_per_key(read_batches(t.spark, out), ["district", "window_start", "window_end"]))


@register(
    "str4",
    f"""WITH src AS (SELECT *, {CENTS} AS m FROM gold), {slid('src', 'processed_at', 360, 180)}, {STATS}
SELECT {STATS_SHOWN}, round(z_score, 6) AS z_score FROM scored WHERE z_score > 2 OR (stddev_severity IS NULL AND max_severity >= 10000)""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    out = outputs(t, "zscore")
    with state_partitions(t.spark):
        drain(start_zscore(in_cents(gold_stream(t)), out, t.work_dir("checkpoint"), {"measure": "cents", **HOURS}, {"lone_max": 10_000}, **ONCE))
    return rounded(newest_per_key(read_batches(t.spark, f"{out.root}/zscore_alerts"), ["district", "window_start", "window_end"]))


@register("str5", f"WITH {VOLUME} SELECT * FROM volume", "gold")
def _(t: Tables) -> DataFrame:
    out = t.work_dir("volume")
    with state_partitions(t.spark):
        counted = windows.volume_windows(with_event_time(valid_events(gold_stream(t))))
        drain(
            counted.writeStream.outputMode("update")
            .foreachBatch(to_table(out))
            .option("checkpointLocation", t.work_dir("checkpoint"))
            .trigger(**ONCE)
            .start()
        )
    return newest_per_key(read_batches(t.spark, out), ["source_dataset", "district", "window_start", "window_end"])


def _city_volume(t: Tables) -> Outputs:
    """Volume anomalies per dataset over the whole city."""
    out = outputs(t, "volume")
    city = with_event_time(valid_events(gold_stream(t))).withColumn("district", F.lit("CITY"))
    with state_partitions(t.spark):
        drain(start_volume(city, out, t.work_dir("checkpoint"), threshold=1, **ONCE))
    return out


@register("str6", f"WITH {CITY_VOLUME}, {ANOMALIES} SELECT * FROM anomalies", "gold")
def _(t: Tables) -> DataFrame:
    found = conform(read_batches(t.spark, f"{_city_volume(t).root}/volume_alerts").drop("batch_id"), "alerts")
    return found.drop("detected_at")


VOLUME_MESSAGE = """alert_type string, source_dataset string, district string, window_start timestamp, window_end timestamp,
event_count bigint, threshold int, detected_at timestamp, alert_severity string"""


@register(
    "str7",
    f"""WITH {CITY_VOLUME}, {ANOMALIES} SELECT 'anomaly-alerts' AS topic, 'CITY' AS key, 'volume_threshold' AS alert_type, source_dataset, window_start, window_end, event_count,
  threshold, alert_severity FROM anomalies""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    sent = read_batches(t.spark, f"{_city_volume(t).root}/topics/volume")
    parsed = sent.select("topic", "key", F.from_json("value", VOLUME_MESSAGE).alias("v"))
    return parsed.select("topic", "key", "v.*").drop("detected_at", "district")


def _stored_in_parts(t: Tables, rows: DataFrame, parts: int) -> tuple[str, DataFrame]:
    """A table in files that each hold rows of all windows, and a stream that takes one file a batch."""
    path = t.work_dir("parts")
    rows.repartition(parts, "event_id").write.parquet(path)
    return path, topics.replay(t.spark, path, t.spark.read.parquet(path).schema, files_per_batch=1)


def _volume_in_batches(t: Tables) -> Outputs:
    """City-wide volume anomalies of valid events that come in four batches, most windows in several."""
    out = outputs(t, "volume")
    zoned = [F.col(c).cast("timestamp").alias(c) if k == "timestamp_ntz" else F.col(c) for c, k in t.gold.dtypes]
    _, stream = _stored_in_parts(t, t.gold.select(*zoned), 4)
    city = with_event_time(valid_events(stream)).withColumn("district", F.lit("CITY"))
    with state_partitions(t.spark):
        drain(start_volume(city, out, t.work_dir("checkpoint"), threshold=1, windows={"watermark": "3650 days"}, **ONCE))
    return out


def _live_buffer(t: Tables) -> DataFrame:
    """The newest 150 events of a stream in four batches, which come in no order of time."""
    out = t.work_dir("newest")
    zoned = [F.col(c).cast("timestamp").alias(c) if k == "timestamp_ntz" else F.col(c) for c, k in t.gold.dtypes]
    _, stream = _stored_in_parts(t, t.gold.select(*zoned), 4)
    drain(start_buffer(stream, out, t.work_dir("checkpoint"), **ONCE))
    return read_newest(t.spark, out)


@register("top2b", "SELECT event_id, processed_at FROM gold ORDER BY processed_at DESC NULLS LAST, event_id LIMIT 150", "gold")
def _(t: Tables) -> DataFrame:
    return _live_buffer(t).select("event_id", "processed_at")


@register(
    "agg26b",
    """SELECT count(*) FILTER (WHERE severity >= 4) AS critical_count FROM
  (SELECT severity FROM gold ORDER BY processed_at DESC NULLS LAST, event_id LIMIT 150)""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return critical_in_buffer(_live_buffer(t))


@register("str10c", f"WITH {CITY_VOLUME}, {ANOMALIES} SELECT * FROM anomalies", "gold")
def _(t: Tables) -> DataFrame:
    """Each anomaly once with its newest count, compacted in between."""
    table = f"{_volume_in_batches(t).root}/volume_alerts"
    compact_versions(t.spark, table, ANOMALY_KEYS["volume"])
    return conform(read_versions(t.spark, table, ANOMALY_KEYS["volume"]), "alerts").drop("detected_at")


@register(
    "str7b",
    f"""WITH {CITY_VOLUME}, {ANOMALIES} SELECT source_dataset, window_start, alert_severity AS last_level, 0 AS sent_twice FROM anomalies""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    """The last level sent of each window, and how often one level was sent again."""
    sent = read_batches(t.spark, f"{_volume_in_batches(t).root}/topics/volume")
    v = sent.select("batch_id", F.from_json("value", VOLUME_MESSAGE).alias("v")).select("batch_id", "v.*")
    last = F.max_by("alert_severity", "batch_id").alias("last_level")
    again = (F.count("*") - F.countDistinct("alert_severity")).cast("int").alias("sent_twice")
    return v.groupBy("source_dataset", "window_start").agg(last, again)


@register("str8", MALFORMED, "gold")
def _(t: Tables) -> DataFrame:
    out = t.work_dir("malformed")
    drain(start_malformed(gold_stream(t), out, t.work_dir("checkpoint"), **ONCE))
    return read_batches(t.spark, out).select("event_id", "invalid_reason")


LATE_SPLIT = "TIMESTAMP '2024-01-20 00:00:00'"


@register(
    "str9",
    f"""WITH newest AS (SELECT *, time_bucket(INTERVAL 1 DAY, processed_at) AS window_start FROM gold WHERE processed_at >= {LATE_SPLIT})
SELECT window_start, count(*) AS n FROM newest GROUP BY 1""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    """The newest days arrive first; all older events then come after the watermark and are dropped."""
    events = t.gold.select("event_id", F.col("processed_at").cast("timestamp").alias("processed_at"))
    bus, out, checkpoint = t.work_dir("late"), t.work_dir("windows"), t.work_dir("checkpoint")
    with state_partitions(t.spark):
        for part in (f"processed_at >= {LATE_SPLIT}", f"processed_at < {LATE_SPLIT}"):
            events.filter(part).write.mode("append").parquet(bus)
            stream = topics.replay(t.spark, bus, events.schema, files_per_batch=100_000)
            counts = stream.withWatermark("processed_at", "10 minutes").groupBy(F.window("processed_at", "1 day").alias("w"))
            rows = counts.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")
            drain(rows.writeStream.outputMode("update").foreachBatch(to_table(f"{out}")).option("checkpointLocation", checkpoint).trigger(**ONCE).start())
    return newest_per_key(read_batches(t.spark, out), ["window_start"])


@register("str10b", "SELECT district, count(*) AS n, max(severity) AS worst FROM gold GROUP BY 1", "gold")
def _(t: Tables) -> DataFrame:
    """Versions of running counts, compacted twice, with the last batch repeated in between."""
    out = t.work_dir("versions")
    part = F.pmod(F.xxhash64("event_id"), F.lit(4))

    def batch(i: int) -> None:
        write_batch(t.gold.filter(part <= i).groupBy("district").agg(F.count("*").alias("n"), F.max("severity").alias("worst")), out, i)

    for i in range(3):
        batch(i)
    compact_versions(t.spark, out, ["district"])
    batch(2)
    batch(3)
    compact_versions(t.spark, out, ["district"])
    batch(3)
    return read_versions(t.spark, out, ["district"])


@register(
    "str10",
    """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, processed_at, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM gold GROUP BY 1)
SELECT mode, window_start, n FROM w, (VALUES ('append'), ('update'), ('complete')) m(mode)
WHERE mode <> 'append' OR window_start + INTERVAL 1 HOUR <= (SELECT max(processed_at) FROM gold) - INTERVAL 10 MINUTES""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    """The three output modes of one window: append emits only windows the watermark has passed."""
    found = []
    with state_partitions(t.spark):
        for mode in ("append", "update", "complete"):
            out = t.work_dir(mode)
            hours = gold_stream(t).withWatermark("processed_at", "10 minutes").groupBy(F.window("processed_at", "1 hour").alias("w"))
            rows = hours.agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "n")
            drain(rows.writeStream.outputMode(mode).foreachBatch(to_table(out)).option("checkpointLocation", t.work_dir("checkpoint")).trigger(**ONCE).start())
            found.append(newest_per_key(read_batches(t.spark, out), ["window_start"]).withColumn("mode", F.lit(mode)))
    return found[0].unionByName(found[1]).unionByName(found[2])


@register("str11", "SELECT source_dataset, count(*) AS n, count(DISTINCT event_id) AS events FROM gold GROUP BY 1", "gold")
def _(t: Tables) -> DataFrame:
    """A restart from the checkpoint finds nothing left to do: every event is stored once."""
    out, checkpoint = outputs(t, "restart"), t.work_dir("checkpoint")
    for _ in range(2):
        drain(start_main(enrich(gold_stream(t).drop("processed_at", "value")), out, checkpoint, **ONCE))
    stored = read_batches(t.spark, f"{out.root}/events").groupBy("source_dataset")
    return stored.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))


@register(
    "str12",
    """SELECT 'main' AS query, count(*) AS n FROM gold UNION ALL
SELECT 'malformed', count(*) FROM gold WHERE incident_date = '' OR coalesce(district, '') = '' UNION ALL
SELECT 'counters', count(*) FROM gold UNION ALL SELECT 'metrics', count(*) FROM gold""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    """The whole application: six queries side by side in one session."""
    out, checkpoint = outputs(t, "app"), t.work_dir("checkpoint")
    with state_partitions(t.spark):
        drain(*start_all(gold_stream(t).drop("processed_at", "value"), out, checkpoint, **ONCE))

    def total(folder: str, label: str, measure=F.count("*")) -> DataFrame:
        rows = read_batches(t.spark, f"{out.root}/{folder}")
        if folder in ("counters", "metrics"):
            keys = ["severity", "dataset"] if folder == "counters" else ["window_start", "window_end", "district"]
            rows = newest_per_key(rows, keys)
        return rows.agg(measure.cast("bigint").alias("n")).select(F.lit(label).alias("query"), "n")

    return (
        total("events", "main")
        .unionByName(total("malformed", "malformed"))
        .unionByName(total("counters", "counters", F.sum("events_total")))
        .unionByName(total("metrics", "metrics", F.sum("event_count")))
    )


@register("str13", "SELECT severity, count(*) AS n FROM gold GROUP BY 1", "gold")
def _(t: Tables) -> DataFrame:
    """With best effort a sink that cannot be reached does not stop the others."""
    root = t.work_dir("isolated")
    out = Outputs(root, TopicTarget(), best_effort=True)
    drain(start_main(enrich(gold_stream(t).drop("processed_at", "value")), out, t.work_dir("checkpoint"), **ONCE))
    return read_batches(t.spark, f"{root}/events").groupBy("severity").agg(F.count("*").alias("n"))


@register("str15", COUNTERS, "gold")
def _(t: Tables) -> DataFrame:
    out = t.work_dir("counters")
    with state_partitions(t.spark):
        drain(start_counters(gold_stream(t), out, t.work_dir("checkpoint"), **ONCE))
    return newest_per_key(read_batches(t.spark, out), ["severity", "dataset"])


# Sinks ------------------------------------------------------------------------------------------


@register("snk1", f"WITH {TRENDS} SELECT * FROM trends", "crimes")
def _(t: Tables) -> DataFrame:
    root = t.work_dir("tables")
    for _ in range(2):  # a second run replaces the first
        overwrite_table(trends.crime_trends(t.crimes), root, "crime_trends")
    return read_table(t.spark, root, "crime_trends")


@register("snk2", "SELECT event_id, severity FROM gold", "gold")
def _(t: Tables) -> DataFrame:
    out, slim = t.work_dir("appended"), t.gold.select("event_id", "severity")
    write_batch(slim.filter("severity >= 3"), out, 0)
    write_batch(slim.filter("severity < 3 or severity is null"), out, 1)
    write_batch(slim.filter("severity >= 3"), out, 0)  # a repeated batch replaces itself
    return read_batches(t.spark, out).drop("batch_id")


@register("snk3", "SELECT event_id, source_dataset, severity FROM gold WHERE severity >= 3", "gold")
def _(t: Tables) -> DataFrame:
    out = t.work_dir("documents")
    write_documents(alerts_only(t.gold).select("event_id", "source_dataset", "severity"), out, 0)
    return read_batches(t.spark, out, "event_id string, source_dataset string, severity int", "json").drop("batch_id")


@register("snk4", ALERTS, "gold")
def _(t: Tables) -> DataFrame:
    """Alert messages of the stream, read back from their topics."""
    sent = read_batches(t.spark, f"{_main(t, 'routed').root}/topics/alerts")
    parsed = topics.parse_alerts(sent.select("topic", "value"))
    return parsed.select("topic", *[c for c in ALERT_MESSAGE.fieldNames() if c != "processed_timestamp_api"])


ZSCORE_MESSAGE = """alert_type string, district string, window_start timestamp, window_count bigint, mean_severity double,
stddev_severity double, max_severity double, z_score double, detected_at bigint"""


@register(
    "snk5",
    f"""WITH src AS (SELECT *, value AS m FROM gold), {slid('src', 'processed_at', 360, 180)}, {STATS}
SELECT 'anomaly-alerts' AS topic, district AS key, 'z_score' AS alert_type, window_start, window_count, max_severity
FROM scored WHERE z_score > 2 OR (stddev_severity IS NULL AND max_severity >= 100)""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    scored = windows.score(windows.sliding_stats(t.gold, measure="value", size="6 hours", slide="3 hours"), lone_max=100)
    root = t.work_dir("anomalies")
    TopicTarget(folder=root).write(on_topic(windows.zscore_alerts(scored)), "zscore", 0)
    parsed = read_batches(t.spark, f"{root}/zscore").select("topic", "key", F.from_json("value", ZSCORE_MESSAGE).alias("v"))
    return parsed.select("topic", "key", "v.alert_type", "v.window_start", "v.window_count", "v.max_severity")


@register(
    "snk6",
    """SELECT 'raw-events-' || coalesce(source_dataset, 'unknown') AS topic, count(*) AS messages_total FROM gold GROUP BY 1""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    root = t.work_dir("published")
    TopicTarget(folder=root).write(raw_messages(t.gold), "raw", 0)
    return topic_counters(read_batches(t.spark, f"{root}/raw"))


@register("snk6b", """SELECT 'raw-events-' || coalesce(source_dataset, 'unknown') AS topic, 2 * count(*) AS sent, 2 * count(*) AS keys FROM gold GROUP BY 1""", "gold")
def _(t: Tables) -> DataFrame:
    """Keys of two runs of a producer over the same rows, each of them there twice: every message of the second has a key of the first."""
    root = t.work_dir("published")
    for run, files in enumerate((3, 5)):
        events = crime_content(written_twice(t, t.gold.select(*UNIFIED_COLUMNS), files))
        TopicTarget(folder=root).write(raw_messages(unique_ids(events)), "raw", run)
    both = read_batches(t.spark, f"{root}/raw")
    return both.groupBy("topic").agg(F.count_if(F.col("batch_id") == 1).alias("sent"), F.countDistinct(F.unhex("key")).alias("keys"))


@register("snk7", COUNTERS, "gold")
def _(t: Tables) -> DataFrame:
    """The counters that the console shows, whole, from a table: the last batch's rows."""
    out = t.work_dir("counters")
    with state_partitions(t.spark):
        drain(start_counters(gold_stream(t), out, t.work_dir("checkpoint"), **ONCE))
    rows = read_batches(t.spark, out)
    last = rows.agg(F.max("batch_id").alias("b")).scalar()
    return rows.filter(F.col("batch_id") == last).select("severity", "dataset", "events_total")


@register("snk8", f"SELECT invalid_reason, count(*) AS n FROM ({MALFORMED}) GROUP BY 1", "gold")
def _(t: Tables) -> DataFrame:
    """The dead-letter table, by reason."""
    out = t.work_dir("dead")
    drain(start_malformed(gold_stream(t), out, t.work_dir("checkpoint"), **ONCE))
    return read_batches(t.spark, out).groupBy("invalid_reason").agg(F.count("*").alias("n"))


@register("snk9", f"SELECT coalesce(source_dataset, 'unknown') AS dataset, {MEASURES} FROM gold GROUP BY source_dataset", "gold")
def _(t: Tables) -> DataFrame:
    """Enriched events pass the table contract, are stored, and serve a summary."""
    zoned = t.gold.withColumns({c: F.col(c).cast("timestamp") for c in ("kafka_timestamp", "processed_at")})
    enriched = enrich(zoned.drop("processed_at", "value"), now=F.col("kafka_timestamp"))
    root = t.work_dir("contract")
    overwrite_table(enriched, root, "events")
    stored = t.spark.read.schema(T.StructType(TABLES["events"].fields)).parquet(f"{root}/events")
    return dataset_summary(stored.select(*UNIFIED_COLUMNS, "processed_at"))
