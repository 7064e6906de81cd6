"""From raw documents to token records: the stages of the training-text pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beatwatch.llm import minhash, mixing, queries, records, repetition, tiling
from beatwatch.llm.ship import ship
from beatwatch.session import scratch, shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    ship(spark)
    return repetition.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, five-word shingles alike to 80 percent or more."""
    ship(spark)
    return minhash.without_duplicates(docs, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return tiling.without_contaminated(docs, queries.benchmark(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    ship(spark)
    return mixing.mixed_documents(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places and checksums of all token sequences, read back from record files."""
    ship(spark)
    read = records.encoded_documents(docs, queries.byte_bpe, digest=True)
    return read.withColumnRenamed("n_ids", "n_tokens").select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_records", token_records),
]

# tokenization has no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents, each written to the shared folder and read again.

    What a stage wrote for itself is dropped when its result is there.
    """
    docs = queries.documents(spark, sf_dir)
    where = shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
