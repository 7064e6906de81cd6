"""Message sinks: rows routed by a topic column, to Kafka or to files partitioned by topic."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beatwatch.functions.envelope import encode
from beatwatch.schemas import ALERT_COLUMNS, UNIFIED_COLUMNS

ANOMALY_TOPIC = "anomaly-alerts"


@dataclass(frozen=True)
class TopicTarget:
    """Kafka brokers, or a folder that stands in for them."""

    brokers: str | None = None
    folder: str | None = None

    def write(self, messages: DataFrame, label: str, batch_id: int) -> None:
        """Send (topic, key, value). The folder form replaces a repeated batch; Kafka is at least once."""
        if self.brokers:
            messages.write.format("kafka").option("kafka.bootstrap.servers", self.brokers).save()
        elif self.folder:
            path = f"{self.folder.rstrip('/')}/{label}/batch_id={batch_id}"
            messages.write.mode("overwrite").option("compression", "zstd").partitionBy("topic").parquet(path)
        else:
            raise ValueError("give brokers or a folder")


def topic_name(prefix: str, dataset: Column | str = "source_dataset") -> Column:
    """Topic of a row's dataset; a row without one goes to the 'unknown' topic."""
    named = F.col(dataset) if isinstance(dataset, str) else dataset
    return F.concat(F.lit(prefix), F.coalesce(named, F.lit("unknown")))


def raw_messages(
    events: DataFrame, schema_id: int = 1, codec: str = "json", keep: Sequence[Column] = ()
) -> DataFrame:
    """Unified events as wire messages, keyed by event so a busy dataset spreads over partitions.

    ``keep`` adds columns to the message, such as its time when files stand in for a broker.
    """
    return events.select(
        topic_name("raw-events-").alias("topic"),
        F.col("event_id").alias("key"),
        encode(F.struct(*UNIFIED_COLUMNS), schema_id, codec).alias("value"),
        *keep,
    )


def alert_messages(enriched: DataFrame) -> DataFrame:
    """Alert events as JSON for their dataset's topic."""
    staged = enriched.withColumn("processed_timestamp_api", F.unix_millis(F.col("processed_at").cast("timestamp")))
    return staged.select(
        topic_name("alerts-").alias("topic"),
        F.col("event_id").alias("key"),
        F.to_json(F.struct(*ALERT_COLUMNS)).alias("value"),
    )


def on_topic(messages: DataFrame, topic: str = ANOMALY_TOPIC) -> DataFrame:
    return messages.select(F.lit(topic).alias("topic"), "key", "value")
