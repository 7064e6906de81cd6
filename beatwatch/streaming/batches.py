"""foreachBatch bodies. Every write goes to a place named by the batch id, so a retry replaces it."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from beatwatch.functions.severity import ALERT_FROM
from beatwatch.operators.enrich import alerts_only
from beatwatch.operators.windows import volume_alerts, zscore_alerts
from beatwatch.schemas import conform
from beatwatch.sinks.tables import earlier_versions, merge_newest, write_batch, write_documents
from beatwatch.sinks.topics import TopicTarget, alert_messages, on_topic

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Outputs:
    """Where the streams write. ``best_effort`` logs a failed sink and goes on; the default fails
    the batch, which the engine then repeats."""

    root: str
    topics: TopicTarget
    best_effort: bool = False

    def attempt(self, label: str, action: Callable[[], None]) -> None:
        try:
            action()
        except Exception:
            if not self.best_effort:
                raise
            log.exception("sink %s failed, batch goes on", label)


def fan_out(outputs: Outputs) -> Callable[[DataFrame, int], None]:
    """All events to a table; alerts to documents and to their dataset's topic."""

    def body(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if kept.isEmpty():
                return
            alerts = alerts_only(kept)
            outputs.attempt("events", lambda: write_batch(conform(kept, "events"), f"{outputs.root}/events", batch_id))
            outputs.attempt("documents", lambda: write_documents(alerts, f"{outputs.root}/alert_documents", batch_id))
            outputs.attempt("topics", lambda: outputs.topics.write(alert_messages(alerts), "alerts", batch_id))
        finally:
            kept.unpersist()

    return body


# What names an anomaly, and the column in which it may rise.
ANOMALY_KEYS = {
    "volume": ["source_dataset", "district", "window_start", "window_end"],
    "zscore": ["district", "window_start", "window_end"],
}
ANOMALY_LEVEL = {"volume": "alert_severity"}


def not_yet_sent(batch: DataFrame, path: str, kind: str, batch_id: int) -> DataFrame:
    """The rows of a batch whose anomaly was not in the table before, or had another level there.

    A window's count only grows, so its level only rises, and the newest stored version tells all that was sent. Only
    stored windows of the batch's span are read; a repeated batch is compared with what was there before it.
    """
    keys, level = ANOMALY_KEYS[kind], ANOMALY_LEVEL.get(kind)
    before = earlier_versions(batch.sparkSession, path, keys, batch_id)
    if before is None:
        return batch
    span = batch.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b")).first()
    known = before.filter(F.col("window_start").between(span["a"], span["b"])).select(*[F.col(c).alias(f"_{c}") for c in [*keys, *([level] if level else [])]])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, *([level] if level else [])]]
    return batch.join(known, reduce(lambda a, b: a & b, same), "left_anti")


def anomaly_fan_out(outputs: Outputs, kind: str) -> Callable[[DataFrame, int], None]:
    """Anomalies to a table of versions; what is new in them to the anomaly topic, new volume anomalies also to a document log.

    The update-mode stream gives a window again whenever its count grows: ``read_versions`` of the table has it
    once, with the newest count, and it is sent once for each level that it reaches.
    """
    message = {"volume": volume_alerts, "zscore": zscore_alerts}[kind]
    checked = (lambda df: conform(df, "alerts")) if kind == "volume" else (lambda df: df)

    def body(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if kept.isEmpty():
                return
            table = f"{outputs.root}/{kind}_alerts"
            outputs.attempt("table", lambda: write_batch(checked(kept), table, batch_id))
            new = not_yet_sent(kept, table, kind, batch_id)
            if kind == "volume":
                outputs.attempt("log", lambda: write_documents(new, f"{outputs.root}/volume_log", batch_id))
            outputs.attempt("topic", lambda: outputs.topics.write(on_topic(message(new)), kind, batch_id))
        finally:
            kept.unpersist()

    return body


def to_table(path: str) -> Callable[[DataFrame, int], None]:
    """Micro-batches of any mode to a table of versions."""

    def body(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return body


def to_buffer(path: str, n: int = 150) -> Callable[[DataFrame, int], None]:
    """The newest ``n`` rows of all batches so far, at ``path``."""

    def body(batch: DataFrame, batch_id: int) -> None:
        merge_newest(batch, path, batch_id, n)

    return body


def print_rows(batch_id: int, rows: list[Row]) -> None:
    print(f"-- batch {batch_id}", *rows, sep="\n")


def to_console(limit: int = 20, emit: Callable[[int, list[Row]], None] = print_rows) -> Callable[[DataFrame, int], None]:
    """Show the first rows of each micro-batch. Only those reach the driver; the console format of
    the engine would send it the whole batch."""

    def body(batch: DataFrame, batch_id: int) -> None:
        emit(batch_id, batch.limit(limit).collect())

    return body


def counted(df: DataFrame, name: str | Observation) -> DataFrame:
    """Count events and alerts while they pass, instead of running extra count jobs."""
    return df.observe(
        name, F.count(F.lit(1)).alias("events"), F.count_if(F.coalesce(F.col("severity") >= ALERT_FROM, F.lit(False))).alias("alerts")
    )
