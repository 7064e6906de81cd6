"""Registered queries: summaries, pages and windows over the enriched events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from beatwatch.operators import health, paging, summaries, windows
from beatwatch.operators.enrich import valid_events, with_event_time
from beatwatch.plans.registry import Tables, register
from beatwatch.schemas import STREAMED_DATASETS
from beatwatch.sinks.tables import compact_events
from beatwatch.streaming.batches import counted

MEASURES = """count(*) AS total_events, coalesce(avg(severity), 0) AS avg_severity,
  CAST(sum(CASE WHEN severity >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS critical_count, max(processed_at) AS last_seen"""
DISTRICTS = f"SELECT district, {MEASURES} FROM gold WHERE district IS NOT NULL GROUP BY district"
NOW = "(SELECT max(processed_at) FROM gold)"


@register("agg14", DISTRICTS, "gold")
def _(t: Tables) -> DataFrame:
    return summaries.district_summary(t.gold)


@register("agg15", f"SELECT coalesce(source_dataset, 'unknown') AS dataset, {MEASURES} FROM gold GROUP BY source_dataset", "gold")
def _(t: Tables) -> DataFrame:
    return summaries.dataset_summary(t.gold)


@register(
    "agg16",
    f"""SELECT date_trunc('hour', processed_at) AS hour, count(*) AS event_count, coalesce(avg(severity), 0) AS avg_severity
FROM gold WHERE processed_at > {NOW} - INTERVAL 168 HOURS GROUP BY 1""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return summaries.hourly_trend(t.gold, summaries.latest(t.gold), 168)


@register("agg18", "SELECT coalesce(severity, 1) AS severity, count(*) AS count FROM gold GROUP BY gold.severity", "gold")
def _(t: Tables) -> DataFrame:
    return summaries.severity_histogram(t.gold)


@register(
    "agg23",
    """WITH c AS (SELECT CAST(s AS INT) AS severity, count(gold.severity) AS count FROM range(1, 6) r(s) LEFT JOIN gold ON gold.severity = s GROUP BY s)
SELECT severity, count, round(count * 100.0 / sum(count) OVER (), 2) AS percent FROM c""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return summaries.severity_shares(t.gold, summaries.rolling_buffer(t.gold))


@register("agg24", f"SELECT count(*) AS events_per_min FROM gold WHERE processed_at > {NOW} - INTERVAL 60 SECONDS", "gold")
def _(t: Tables) -> DataFrame:
    return summaries.recent_count(t.gold, summaries.latest(t.gold))


@register(
    "agg25",
    f"SELECT count(DISTINCT district) AS active_districts FROM gold WHERE district <> '' AND processed_at > {NOW} - INTERVAL 36000 SECONDS",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return summaries.active_districts(t.gold, summaries.latest(t.gold), 36_000)


@register(
    "agg26",
    """SELECT count(*) FILTER (WHERE severity >= 4) AS critical_count FROM
  (SELECT severity FROM gold ORDER BY processed_at DESC, event_id LIMIT 150)""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return summaries.critical_in_buffer(t.gold)


@register(
    "agg27",
    """SELECT coalesce(CAST(severity AS VARCHAR), 'unknown') AS severity, coalesce(source_dataset, 'unknown') AS dataset, count(*) AS events_total
FROM gold GROUP BY 1, 2""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return summaries.event_counters(t.gold)


@register(
    "agg28",
    "SELECT count(*) AS all_events, "
    + ", ".join(f"count(*) FILTER (WHERE source_dataset = '{d}') AS {d.replace('-', '_')}" for d in STREAMED_DATASETS)
    + " FROM gold",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return summaries.totals(t.gold, STREAMED_DATASETS)


@register(
    "agg29",
    """SELECT time_bucket(INTERVAL 1 MINUTE, processed_at) AS window_start, source_dataset, count(*) / 60 AS events_per_second FROM gold GROUP BY 1, 2""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return windows.rate_per_second(t.gold, "source_dataset")


@register(
    "agg29b",
    """SELECT time_bucket(INTERVAL 1 MINUTE, processed_at) AS window_start, severity, count(*) / 60 AS events_per_second FROM gold GROUP BY 1, 2""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return windows.rate_per_second(t.gold, "severity")


@register("agg30", "SELECT count(*) AS events, count(*) FILTER (WHERE severity >= 3) AS alerts FROM gold", "gold")
def _(t: Tables) -> DataFrame:
    seen = Observation("batch")
    rows = counted(t.gold.select("event_id", "severity"), seen)
    rows.write.mode("overwrite").parquet(t.work_dir("observed"))
    return t.spark.createDataFrame([(seen.get["events"], seen.get["alerts"])], "events bigint, alerts bigint")


@register("win1", f"WITH d AS ({DISTRICTS}) SELECT district, total_events, total_events / (SELECT greatest(max(total_events), 1) FROM d) AS intensity FROM d", "gold")
def _(t: Tables) -> DataFrame:
    return summaries.intensity(summaries.district_summary(t.gold)).select("district", "total_events", "intensity")


# Pages --------------------------------------------------------------------------------------

NEWEST = "ORDER BY processed_at DESC, event_id"


@register("top2", f"SELECT event_id, processed_at FROM gold {NEWEST} LIMIT 150", "gold")
def _(t: Tables) -> DataFrame:
    return summaries.rolling_buffer(t.gold.select("event_id", "processed_at"))


@register("top3d", f"WITH d AS ({DISTRICTS}) SELECT * FROM d ORDER BY total_events DESC, district LIMIT 8", "gold")
def _(t: Tables) -> DataFrame:
    return summaries.district_summary(t.gold).limit(8)


@register("pag1", f"SELECT * EXCLUDE (kafka_timestamp, value) FROM gold WHERE source_dataset = 'crimes' {NEWEST} LIMIT 100 OFFSET 40", "gold")
def _(t: Tables) -> DataFrame:
    return paging.event_history(t.gold.drop("kafka_timestamp", "value"), "crimes", 100, 40)


@register("pag1b", f"SELECT event_id, processed_at FROM gold {NEWEST} LIMIT 500 OFFSET 6543", "gold")
def _(t: Tables) -> DataFrame:
    return paging.deep_page(t.gold.select("event_id", "processed_at"), 6543, 500)


@register("pag2", f"SELECT event_id, source_dataset, severity, processed_at FROM gold WHERE severity >= 3 AND source_dataset = 'violence' {NEWEST} LIMIT 20", "gold")
def _(t: Tables) -> DataFrame:
    alerts = t.gold.filter("severity >= 3").select("event_id", "source_dataset", "severity", "processed_at")
    return paging.recent_alerts(alerts, "violence", limit=1000)


@register(
    "pag3",
    """WITH n AS (SELECT floor((100 - 37) / 100 * greatest(count(*) - 50, 0) + 0.5) AS skip FROM gold),
r AS (SELECT event_id, processed_at, row_number() OVER (ORDER BY processed_at DESC, event_id) AS rn FROM gold)
SELECT event_id, processed_at FROM r, n WHERE rn > skip AND rn <= skip + 50""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    rows = t.gold.select("event_id", "processed_at")
    return paging.replay_page(rows, 37, paging.write_order_index(rows, t.work_dir("order")))


@register("pag3b", "SELECT event_id, processed_at FROM gold ORDER BY processed_at, event_id DESC LIMIT 50", "gold")
def _(t: Tables) -> DataFrame:
    """The oldest page of the compacted event table, by the index that the compaction keeps beside it."""
    path, order = t.work_dir("compacted"), t.work_dir("order")
    rows = t.gold.select("event_id", "source_dataset", F.col("processed_at").cast("timestamp").alias("processed_at"))
    compact_events(rows, path, index=order)
    stored = t.spark.read.parquet(path)
    return paging.replay_page(stored, 0, t.spark.read.parquet(order)).select("event_id", "processed_at")


# Windows over stored events ------------------------------------------------------------------


def slid(source: str, ts: str, size: int, slide: int) -> str:
    """Each row once per sliding window it lies in, as SQL (sizes in minutes)."""
    base = f"time_bucket(INTERVAL {slide} MINUTES, {ts}, TIMESTAMP '1970-01-01') - to_minutes(i * {slide})"
    return f"""slid AS (SELECT s.*, {base} AS window_start, {base} + INTERVAL {size} MINUTES AS window_end
  FROM {source} s, range(0, {-(-size // slide)}) k(i) WHERE {ts} < {base} + INTERVAL {size} MINUTES)"""


STATS = """stats AS (SELECT district, window_start, window_end, count(event_id) AS window_count, avg(m) AS mean_severity,
  stddev_samp(m) AS stddev_severity, max(m) AS max_severity FROM slid GROUP BY 1, 2, 3),
scored AS (SELECT *, CASE WHEN stddev_severity > 0 THEN (max_severity - mean_severity) / stddev_severity ELSE 0 END AS z_score FROM stats)"""
# deviations are rounded, as engines differ in their last bits; means of whole numbers are exact
STATS_SHOWN = """district, window_start, window_end, window_count, mean_severity, round(stddev_severity, 6) AS stddev_severity, max_severity"""


def rounded(df: DataFrame) -> DataFrame:
    shown = [c for c in ("stddev_severity", "z_score") if c in df.columns]
    return df.withColumns({c: F.round(c, 6) for c in shown})


CENTS = "CAST(round(value * 100) AS INT)"


def in_cents(events: DataFrame) -> DataFrame:
    """The event value as a whole number: a measure with more spread than the severity."""
    return events.withColumn("cents", F.round(F.col("value") * 100).cast("int"))


HOURS = {"size": "6 hours", "slide": "3 hours"}


@register("str3b", f"WITH src AS (SELECT *, severity AS m FROM gold), {slid('src', 'processed_at', 360, 180)}, {STATS} SELECT {STATS_SHOWN} FROM stats", "gold")
def _(t: Tables) -> DataFrame:
    return rounded(windows.sliding_stats(t.gold, **HOURS))


@register(
    "str4b",
    f"""WITH src AS (SELECT *, {CENTS} AS m FROM gold), {slid('src', 'processed_at', 360, 180)}, {STATS}
SELECT {STATS_SHOWN}, round(z_score, 6) AS z_score FROM scored WHERE z_score > 2 OR (stddev_severity IS NULL AND max_severity >= 10000)""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return rounded(windows.score(windows.sliding_stats(in_cents(t.gold), measure="cents", **HOURS), lone_max=10_000))


VALID = """valid AS (SELECT *, coalesce(try_strptime(incident_date || ' ' || incident_time, '%m/%d/%Y %H:%M:%S'),
  try_strptime(incident_date || ' ' || incident_time, '%m/%d/%Y %H:%M'), try_strptime(incident_date, '%m/%d/%Y'), kafka_timestamp) AS event_time
  FROM gold WHERE incident_date <> '' AND district <> '')"""
VOLUME = f"""{VALID}, {slid('valid', 'event_time', 5, 1)}, volume AS (
  SELECT source_dataset, district, window_start, window_end, count(*) AS event_count, min(kafka_timestamp) AS window_first_event,
         max(kafka_timestamp) AS window_last_event FROM slid GROUP BY 1, 2, 3, 4)"""
CITY_VOLUME = VOLUME.replace("SELECT source_dataset, district, window_start", "SELECT source_dataset, 'CITY' AS district, window_start")


def valid_gold(t: Tables) -> DataFrame:
    return with_event_time(valid_events(t.gold))


@register("str5b", f"WITH {VOLUME} SELECT * FROM volume", "gold")
def _(t: Tables) -> DataFrame:
    return windows.volume_windows(valid_gold(t))


ANOMALIES = """anomalies AS (SELECT *, 1 AS threshold, CASE WHEN event_count > 3 THEN 'CRITICAL' WHEN event_count > 2 THEN 'HIGH' ELSE 'MEDIUM' END AS alert_severity
  FROM volume WHERE event_count > 1)"""


@register("str6b", f"WITH {CITY_VOLUME}, {ANOMALIES} SELECT * FROM anomalies", "gold")
def _(t: Tables) -> DataFrame:
    city = valid_gold(t).withColumn("district", F.lit("CITY"))
    return windows.volume_anomalies(windows.volume_windows(city), threshold=1).drop("detected_at")


# Stream health ------------------------------------------------------------------------------


AS_OF = "2024-01-31 06:01:00"


def grid(minutes: int, keyed: bool, failing: str, hold: int) -> str:
    """Every whole window up to AS_OF (per dataset) with its count, and the failing ones that have held, as SQL."""
    bucket = f"time_bucket(INTERVAL {minutes} MINUTES, processed_at, TIMESTAMP '1970-01-01')"
    length = f"INTERVAL {minutes} MINUTES"
    key = "source_dataset" if keyed else "1 AS one"
    name = "source_dataset" if keyed else "one"
    need = max(1, -(-hold // minutes))
    return f"""first AS (SELECT min({bucket}) AS b, min(processed_at) AS t FROM gold),
grid AS (SELECT window_start, {name} FROM (SELECT unnest(generate_series((SELECT CASE WHEN t > b THEN b + {length} ELSE b END FROM first),
    TIMESTAMP '{AS_OF}' - {length}, {length})) AS window_start), (SELECT DISTINCT {key} FROM gold)),
seen AS (SELECT {bucket} AS window_start, {key}, count(*) AS n FROM gold GROUP BY 1, 2),
rates AS (SELECT g.window_start, g.{name}, coalesce(n, 0) AS event_count, coalesce(n, 0) / {minutes * 60} AS events_per_second
  FROM grid g LEFT JOIN seen s ON g.window_start = s.window_start AND g.{name} IS NOT DISTINCT FROM s.{name}),
run AS (SELECT *, sum(CASE WHEN {failing} THEN 1 ELSE 0 END) OVER (PARTITION BY {name} ORDER BY window_start ROWS BETWEEN {need - 1} PRECEDING AND CURRENT ROW) AS held FROM rates)
SELECT * EXCLUDE (held{'' if keyed else ', one'}) FROM run WHERE held = {need}"""


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


@register("str14", f"WITH {grid(5, True, 'event_count = 0', 5)}", "gold")
def _(t: Tables) -> DataFrame:
    return health.silent_datasets(t.gold, as_of=as_of(), hold=5)


@register("str14b", f"WITH {grid(2, False, 'event_count = 0', 3)}", "gold")
def _(t: Tables) -> DataFrame:
    return health.no_events(t.gold, as_of=as_of(), hold=3)


@register("str14c", f"WITH {grid(5, False, 'events_per_second < 0.005', 10)}", "gold")
def _(t: Tables) -> DataFrame:
    return health.low_rate(t.gold, below=0.005, as_of=as_of(), hold=10)


# Windows whose size is no multiple of the slide ------------------------------------------------


ODD = slid("valid", "event_time", 7, 3)


@register(
    "str5c",
    f"""WITH {VALID}, {ODD} SELECT source_dataset, district, window_start, window_end, count(*) AS event_count, min(kafka_timestamp) AS window_first_event,
  max(kafka_timestamp) AS window_last_event FROM slid GROUP BY 1, 2, 3, 4""",
    "gold",
)
def _(t: Tables) -> DataFrame:
    return windows.volume_windows(valid_gold(t), size="7 minutes", slide="3 minutes")
