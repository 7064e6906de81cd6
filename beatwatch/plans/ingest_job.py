"""The ingest job: the streamed CSV datasets, normalised, to the raw event topics, once through."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from beatwatch.operators.normalise import unify
from beatwatch.operators.numbering import unique_ids
from beatwatch.plans.batch_job import FILE_KEYWORDS
from beatwatch.schemas import STREAMED_DATASETS
from beatwatch.session import build_session
from beatwatch.sinks.topics import TopicTarget, raw_messages
from beatwatch.sources.csv_files import find_csv, land_counted, project, split_corrupt


def publish(
    spark: SparkSession, data_dir: str, landing: str, target: TopicTarget, codec: str = "json", partitions: int | None = None
) -> DataFrame:
    """Publish every well-formed row as a unified event; returns ``dataset, read, malformed, published``.

    Each dataset is landed once, which counts its rows, and read from there; its events are written as well and sent
    from that table. Event ids come from a row's content and its number among equal ones, so equal rows are events of
    their own and another run over the same rows sends the same ids. Rows without a place for a field are malformed:
    they stay in the landed table with their text.
    """
    counts = []
    for number, dataset in enumerate(STREAMED_DATASETS):
        raw = project(find_csv(spark, data_dir, FILE_KEYWORDS[dataset], dataset, keep_corrupt=True), dataset)
        landed, seen = land_counted(raw, f"{landing.rstrip('/')}/{dataset}", partitions)
        good, _ = split_corrupt(landed)
        events = f"{landing.rstrip('/')}/events/{dataset}"
        unify({dataset: good}).write.mode("overwrite").parquet(events)
        sent = Observation()
        messages = raw_messages(unique_ids(spark.read.parquet(events)), codec=codec)
        target.write(messages.observe(sent, F.count(F.lit(1)).alias("published")), "raw", number)
        counts.append((dataset, seen["read"], seen["malformed"], sent.get["published"]))
    return spark.createDataFrame(counts, "dataset string, read long, malformed long, published long")


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("data_dir")
    args.add_argument("landing", help="shared folder for the landed rows and the counts")
    args.add_argument("brokers")
    args.add_argument("--codec", choices=("avro", "json"), default="avro")
    args.add_argument("--landing-partitions", type=int)
    given = args.parse_args()
    spark = build_session("beatwatch-ingest")
    counts = publish(spark, given.data_dir, given.landing, TopicTarget(brokers=given.brokers), given.codec, given.landing_partitions)
    counts.coalesce(1).write.mode("overwrite").parquet(f"{given.landing.rstrip('/')}/row_counts")


if __name__ == "__main__":
    main()
