"""The streaming queries. Each takes a streaming frame and returns the started query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from beatwatch.operators.enrich import malformed_events, valid_events, with_event_time
from beatwatch.operators.health import live_rates, live_silence
from beatwatch.operators.summaries import event_counters
from beatwatch.operators.windows import distinct_panes, district_metrics, score, sliding_stats, volume_anomalies, volume_windows
from beatwatch.streaming.batches import Outputs, anomaly_fan_out, counted, fan_out, to_buffer, to_console, to_table


def _start(writer: DataStreamWriter, name: str, checkpoints: str, trigger: dict) -> StreamingQuery:
    """Every query has a name and its own checkpoint under a caller-given shared root."""
    located = writer.queryName(name).option("checkpointLocation", f"{checkpoints.rstrip('/')}/{name}")
    return (located.trigger(**trigger) if trigger else located).start()


def start_main(enriched: DataFrame, outputs: Outputs, checkpoints: str, **trigger) -> StreamingQuery:
    """Fan out enriched events (append mode)."""
    writer = counted(enriched, "events_in_batch").writeStream.outputMode("append").foreachBatch(fan_out(outputs))
    return _start(writer, "main", checkpoints, trigger)


def start_metrics(enriched: DataFrame, path: str | None, checkpoints: str, **trigger) -> StreamingQuery:
    """Ten-second district metrics (update mode), to a table or to the console."""
    writer = district_metrics(enriched).writeStream.outputMode("update")
    return _start(writer.foreachBatch(to_table(path) if path else to_console()), "metrics", checkpoints, trigger)


def start_zscore(enriched: DataFrame, outputs: Outputs, checkpoints: str, windows: dict | None = None, limits: dict | None = None, **trigger) -> StreamingQuery:
    """Sliding z-score anomalies (update mode)."""
    scored = score(sliding_stats(enriched, **(windows or {})), **(limits or {}))
    writer = scored.writeStream.outputMode("update").foreachBatch(anomaly_fan_out(outputs, "zscore"))
    return _start(writer, "zscore", checkpoints, trigger)


def start_volume(events: DataFrame, outputs: Outputs, checkpoints: str, threshold: int = 50, windows: dict | None = None, **trigger) -> StreamingQuery:
    """Volume anomalies of valid events (update mode), every 30 seconds unless told otherwise."""
    timed = with_event_time(valid_events(events)) if "event_time" not in events.columns else events
    found = volume_anomalies(volume_windows(timed, **(windows or {})), threshold)
    writer = found.writeStream.outputMode("update").foreachBatch(anomaly_fan_out(outputs, "volume"))
    return _start(writer, "volume", checkpoints, trigger or {"processingTime": "30 seconds"})


def start_malformed(events: DataFrame, path: str | None, checkpoints: str, **trigger) -> StreamingQuery:
    """Events without a date or district, with the reason: the dead-letter table, or the console."""
    writer = malformed_events(events).writeStream.outputMode("append")
    return _start(writer.foreachBatch(to_table(path) if path else to_console()), "malformed", checkpoints, trigger)


def start_health(
    events: DataFrame, beats: DataFrame, path: str | None, checkpoints: str, minutes: int = 5, below: float | None = None, watermark: str = "1 minute", **trigger
) -> StreamingQuery:
    """Silent (or slow) windows of every expected dataset, each once when it is over (append mode), to a table or the console."""
    found = live_silence(live_rates(events, beats, minutes, watermark=watermark), below)
    writer = found.writeStream.outputMode("append")
    return _start(writer.foreachBatch(to_table(path) if path else to_console()), "health", checkpoints, trigger)


def start_active(events: DataFrame, path: str, checkpoints: str, **trigger) -> StreamingQuery:
    """Sketches of the active districts by pane (update mode); ``distinct_windows`` of the newest versions gives the counts."""
    writer = distinct_panes(events).writeStream.outputMode("update")
    return _start(writer.foreachBatch(to_table(path)), "active", checkpoints, trigger)


def start_buffer(enriched: DataFrame, path: str, checkpoints: str, n: int = 150, **trigger) -> StreamingQuery:
    """The newest ``n`` events, kept up with every batch (append mode)."""
    return _start(enriched.writeStream.outputMode("append").foreachBatch(to_buffer(path, n)), "buffer", checkpoints, trigger)


def start_counters(events: DataFrame, path: str | None, checkpoints: str, show: Callable | None = None, **trigger) -> StreamingQuery:
    """Running totals by severity and dataset (complete mode), to a table or shown on the console."""
    body = to_table(path) if path else show or to_console(100)
    writer = event_counters(events).writeStream.outputMode("complete").foreachBatch(body)
    return _start(writer, "counters", checkpoints, trigger)
