"""Message sources: a Kafka topic pattern, a folder of messages, a replayed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwatch.functions.envelope import decode
from beatwatch.schemas import ALERT_MESSAGE, UNIFIED_COLUMNS

RAW_TOPIC_PATTERN = "raw-events-.*"

MESSAGE = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)


def kafka_stream(
    spark: SparkSession,
    brokers: str,
    pattern: str = RAW_TOPIC_PATTERN,
    starting: str = "latest",
    group_id: str | None = None,
    max_offsets: int | None = None,
) -> DataFrame:
    """Subscribe to every topic matching the pattern. Needs the public spark-sql-kafka package."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribePattern", pattern)
        .option("startingOffsets", starting)
        .option("failOnDataLoss", "false")
    )
    if group_id:
        reader = reader.option("kafka.group.id", group_id)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load()


def folder_stream(spark: SparkSession, path: str, pattern: str = RAW_TOPIC_PATTERN, files_per_batch: int = 100) -> DataFrame:
    """Messages written as files partitioned by topic, filtered by the same topic pattern."""
    rows = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.filter(F.col("topic").rlike(f"^(?:{pattern})$"))


def replay(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A static Parquet table as a stream of micro-batches. ``path`` may be one file or a folder."""
    # a pattern lets the file source take a path that is a single file; the class of one letter names just this path
    whole = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{whole[:-1]}[{whole[-1]}]")


def decode_events(messages: DataFrame, codec: str = "json") -> DataFrame:
    """Wire messages to flat events with their ingest time."""
    staged = messages.select(
        F.col("timestamp").alias("kafka_timestamp"), decode("value", codec).alias("event")
    )
    return staged.select("kafka_timestamp", *[F.col(f"event.{c}").alias(c) for c in UNIFIED_COLUMNS])


def parse_alerts(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON alert messages to rows; text that is no JSON object of the alert shape is skipped."""
    schema = T.StructType([*ALERT_MESSAGE.fields, T.StructField("_bad", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = messages.withColumn("_alert", F.from_json(F.col(value).cast("string"), schema, options))
    usable = parsed.filter(F.col("_alert").isNotNull() & F.col("_alert._bad").isNull() & F.col("_alert.event_id").isNotNull())
    rest = [c for c in messages.columns if c != value]
    return usable.select(*rest, *[F.col(f"_alert.{c}").alias(c) for c in ALERT_MESSAGE.fieldNames()])
