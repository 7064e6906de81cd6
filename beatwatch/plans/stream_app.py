"""The streaming application: all queries in one session."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from beatwatch.operators.enrich import enrich
from beatwatch.operators.health import heartbeats
from beatwatch.schemas import STREAMED_DATASETS
from beatwatch.session import build_session, state_partitions
from beatwatch.sinks.topics import TopicTarget
from beatwatch.sources.topics import decode_events, kafka_stream
from beatwatch.streaming.batches import Outputs
from beatwatch.streaming.queries import (
    start_active,
    start_buffer,
    start_counters,
    start_health,
    start_main,
    start_malformed,
    start_metrics,
    start_volume,
    start_zscore,
)

# State partitions are fixed for a query's life, so they are set before the first start.
STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def start_all(
    events: DataFrame, outputs: Outputs, checkpoints: str, threshold: int = 50, windows: dict | None = None, clock: DataFrame | None = None, **trigger
) -> list[StreamingQuery]:
    """All queries; ``windows`` sets size, slide and watermark of the volume windows.

    ``clock`` is a stream with a ``timestamp``, such as the rate source: with it the streamed datasets are watched for silence.
    """
    enriched = enrich(events)
    watch = [start_health(enriched, heartbeats(clock, STREAMED_DATASETS), f"{outputs.root}/silence", checkpoints, **trigger)] if clock is not None else []
    return [
        *watch,
        start_active(enriched, f"{outputs.root}/active", checkpoints, **trigger),
        start_buffer(enriched, f"{outputs.root}/newest", checkpoints, **trigger),
        start_main(enriched, outputs, checkpoints, **trigger),
        start_metrics(enriched, f"{outputs.root}/metrics", checkpoints, **trigger),
        start_zscore(enriched, outputs, checkpoints, **trigger),
        start_malformed(events, f"{outputs.root}/malformed", checkpoints, **trigger),
        start_volume(events, outputs, checkpoints, threshold, windows, **trigger),
        start_counters(events, f"{outputs.root}/counters", checkpoints, **trigger),
    ]


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("brokers")
    args.add_argument("out", help="shared folder for the tables")
    args.add_argument("checkpoints", help="shared folder for the checkpoints")
    args.add_argument("--codec", choices=("avro", "json"), default="avro")
    args.add_argument("--threshold", type=int, default=50)
    args.add_argument("--window", default="5 minutes")
    args.add_argument("--slide", default="1 minute")
    args.add_argument("--watermark", default="10 minutes")
    args.add_argument("--state-partitions", type=int, help="default: one for each core; fixed for the life of a checkpoint")
    args.add_argument("--best-effort", action="store_true")
    given = args.parse_args()
    spark = build_session("beatwatch-stream", **STREAM_CONF)
    events = decode_events(kafka_stream(spark, given.brokers), given.codec)
    outputs = Outputs(given.out, TopicTarget(brokers=given.brokers), given.best_effort)
    with state_partitions(spark, given.state_partitions):
        clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        start_all(events, outputs, given.checkpoints, given.threshold, {"size": given.window, "slide": given.slide, "watermark": given.watermark}, clock)
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
