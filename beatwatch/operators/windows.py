"""Event-time windows and the two anomaly detectors, for batch and streaming frames alike."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwatch.functions.severity import CRITICAL_FROM
from beatwatch.functions.text import flag

_UNIT_MS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def _late(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    return df.withWatermark(ts, watermark) if df.isStreaming and watermark else df


def _length(text: str) -> int:
    """Milliseconds of a length such as '2 minutes'."""
    number, unit = text.split()
    return int(number) * _UNIT_MS[unit.lower().rstrip("s")]


def _panes(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], partials: list[Column]) -> DataFrame:
    """Partials per pane, as long as the greatest common divisor of size and slide. A sliding window is a run of
    whole panes, so merging panes gives the window without copying every row into each window it belongs to."""
    pane = F.window(ts, f"{gcd(_length(size), _length(slide))} milliseconds")
    return df.groupBy(pane.alias("_pane"), *keys).agg(*partials).withColumn(ts, F.col("_pane.start")).drop("_pane")


def district_metrics(
    events: DataFrame, ts: str = "processed_at", size: str = "10 seconds", watermark: str | None = "30 seconds"
) -> DataFrame:
    """Tumbling counts, mean severity and critical count per district."""
    rows = _late(events, ts, watermark).groupBy(F.window(ts, size).alias("w"), "district")
    return rows.agg(
        F.count("event_id").alias("event_count"),
        F.avg("severity").alias("avg_severity"),
        F.sum(flag(F.col("severity") >= CRITICAL_FROM)).alias("critical_count"),
    ).select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "district",
        "event_count",
        "avg_severity",
        "critical_count",
    )


def _moments(x: Column) -> list[Column]:
    """Count, mean and sum of squared distances from the mean."""
    return [F.count(x).alias("_n"), F.avg(x).alias("_mean"), (F.var_pop(x) * F.count(x)).alias("_m2")]


def _merged_moments() -> Column:
    """``n, mean, m2`` of many ``_moments`` put together two by two, by the distance of their means (Chan's rule).

    Nothing grows with the square of the values, so a mean of millions of deviations does no harm. A group has as many
    parts as a window has panes.
    """
    part = F.struct(F.col("_n").cast("double").alias("n"), F.col("_mean").alias("mean"), F.col("_m2").alias("m2"))

    def merge(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        mean = a["mean"] + apart * b["n"] / n
        m2 = a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n
        return F.struct(n.alias("n"), mean.alias("mean"), m2.alias("m2"))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(F.sort_array(F.collect_list(F.when(F.col("_n") > 0, part))), none, merge)


def sliding_stats(
    events: DataFrame,
    ts: str = "processed_at",
    size: str = "2 minutes",
    slide: str = "30 seconds",
    watermark: str | None = "30 seconds",
    measure: str = "severity",
    key: str = "district",
) -> DataFrame:
    """Count, mean, sample standard deviation and maximum per window and key.

    A batch frame is merged from panes: counts, maxima, and moments by Chan's rule, as the engine merges them in a stream.
    """
    if not events.isStreaming:
        x = F.col(measure).cast("double")
        partials = [F.count("event_id").alias("_c"), *_moments(x), F.max(measure).alias("_m")]
        rows = _panes(events, ts, size, slide, [key], partials).groupBy(F.window(ts, size, slide).alias("w"), key)
        merged = rows.agg(F.sum("_c").alias("_c"), F.max("_m").alias("max_severity"), _merged_moments().alias("_all"))
        n = F.col("_all.n")
        stats = merged.select(
            "w",
            key,
            F.col("_c").alias("window_count"),
            F.when(n > 0, F.col("_all.mean")).alias("mean_severity"),
            F.when(n > 1, F.sqrt(F.col("_all.m2") / (n - 1))).alias("stddev_severity"),
            "max_severity",
        )
    else:
        rows = _late(events, ts, watermark).groupBy(F.window(ts, size, slide).alias("w"), key)
        stats = rows.agg(
            F.count("event_id").alias("window_count"),
            F.avg(measure).alias("mean_severity"),
            F.stddev(measure).alias("stddev_severity"),
            F.max(measure).alias("max_severity"),
        )
    return stats.select(
        key,
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "window_count",
        "mean_severity",
        "stddev_severity",
        "max_severity",
    )


def score(stats: DataFrame, above: float = 2.0, lone_max: float = CRITICAL_FROM) -> DataFrame:
    """Windows whose maximum stands out: z above the limit, or a lone high event (no deviation)."""
    spread = F.col("stddev_severity")
    z = F.when(spread > 0, (F.col("max_severity") - F.col("mean_severity")) / spread).otherwise(F.lit(0.0))
    return stats.withColumn("z_score", z).filter(
        (F.col("z_score") > above) | (spread.isNull() & (F.col("max_severity") >= lone_max))
    )


def zscore_alerts(scored: DataFrame, now: Column | None = None) -> DataFrame:
    """(key, value) alert messages, figures rounded to two digits."""
    # fixed values: the fields of the message
    detected = now if now is not None else F.unix_millis(F.current_timestamp())
    return scored.select(
        F.col("district").alias("key"),
        F.to_json(
            F.struct(
                F.lit("z_score").alias("alert_type"),
                "district",
                "window_start",
                "window_count",
                F.round("mean_severity", 2).alias("mean_severity"),
                F.round("stddev_severity", 2).alias("stddev_severity"),
                "max_severity",
                F.round("z_score", 2).alias("z_score"),
                detected.alias("detected_at"),
            )
        ).alias("value"),
    )


def volume_windows(
    events: DataFrame,
    ts: str = "event_time",
    size: str = "5 minutes",
    slide: str = "1 minute",
    watermark: str | None = "10 minutes",
    keys: tuple[str, ...] = ("source_dataset", "district"),
    ingested: str = "kafka_timestamp",
) -> DataFrame:
    """Events per sliding window and key with the first and last ingest time."""
    firsts = [
        F.count("*").alias("event_count"),
        F.min(ingested).alias("window_first_event"),
        F.max(ingested).alias("window_last_event"),
    ]
    if events.isStreaming:
        rows = _late(events, ts, watermark).groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(*firsts)
    else:
        merged = [F.sum("event_count").alias("event_count"), F.min("window_first_event").alias("window_first_event")]
        merged.append(F.max("window_last_event").alias("window_last_event"))
        panes = _panes(events, ts, size, slide, list(keys), firsts)
        rows = panes.groupBy(F.window(ts, size, slide).alias("w"), *keys).agg(*merged)
    return rows.select(
        *keys,
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "event_count",
        "window_first_event",
        "window_last_event",
    )


def volume_anomalies(windows: DataFrame, threshold: int = 50, now: Column | None = None) -> DataFrame:
    """Windows above the threshold; HIGH above twice, CRITICAL above three times."""
    n = F.col("event_count")
    return windows.filter(n > threshold).withColumns(
        {
            "threshold": F.lit(threshold),
            "detected_at": now if now is not None else F.current_timestamp(),
            "alert_severity": F.when(n > threshold * 3, "CRITICAL").when(n > threshold * 2, "HIGH").otherwise("MEDIUM"),
        }
    )


def volume_alerts(anomalies: DataFrame) -> DataFrame:
    """(key, value) alert messages."""
    # fixed values: the fields of the message
    fields = ("source_dataset", "district", "window_start", "window_end", "event_count", "threshold", "detected_at", "alert_severity")
    body = F.struct(F.lit("volume_threshold").alias("alert_type"), *fields)
    return anomalies.select(F.col("district").alias("key"), F.to_json(body).alias("value"))


def rate_per_second(events: DataFrame, key: str, ts: str = "processed_at", size: str = "1 minute", seconds: int = 60, watermark: str | None = "1 minute") -> DataFrame:
    """Events per second in tumbling windows, per key."""
    rows = _late(events, ts, watermark).groupBy(F.window(ts, size).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), key, (F.col("n") / seconds).alias("events_per_second"))


def distinct_panes(
    events: DataFrame,
    column: str = "district",
    ts: str = "processed_at",
    size: str = "5 minutes",
    slide: str = "1 minute",
    watermark: str | None = "1 minute",
    lg_k: int = 12,
) -> DataFrame:
    """``pane_start, sketch``: a HyperLogLog sketch of the non-empty values for each pane; batch or stream.

    A sketch has at most 2^lg_k registers, whatever the pane holds: the state of a stream is a few sketches. Its
    standard error is 1.04 / sqrt(2^lg_k), 1.6 percent as set; up to some hundred values it counts exactly.
    """
    pane = F.window(ts, f"{gcd(_length(size), _length(slide))} milliseconds")
    rows = _late(events.filter(F.col(column) != ""), ts, watermark).groupBy(pane.alias("w"))
    return rows.agg(F.hll_sketch_agg(column, lg_k).alias("sketch")).select(F.col("w.start").alias("pane_start"), "sketch")


def distinct_windows(panes: DataFrame, size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """``window_start, window_end, distinct_count`` of every sliding window, from the sketches of its panes."""
    rows = panes.groupBy(F.window("pane_start", size, slide).alias("w")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_count"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "distinct_count")
