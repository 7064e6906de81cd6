"""The registered queries of the training-text operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatwatch.llm import language, minhash, mixing, pii, quality_net, recompression, records, repetition, search, sharding, suffix_tree, tiling, whitening
from beatwatch.llm.ship import ship


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")


def op1_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a suffix tree of four fifths of the documents."""
    return suffix_tree.score_texts(documents(spark, sf_dir))


def op2_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and survivor of every document, linked at 85 percent of five-word shingles."""
    return minhash.near_duplicates(documents(spark, sf_dir), percent=85)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document by the mix of all sources."""
    mixed = mixing.mix(documents(spark, sf_dir))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "source", "copies")


def op4_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and digest of the base kinds, and all spans."""
    found = pii.personal_data(documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [of(kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]]
    more = [of(kind).alias(f"n_{kind}") for kind in pii.KINDS[4:]]
    digest = F.sha2(F.encode(written(base), "UTF-8"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, written(F.col("spans")).alias("spans"), *more)


def op5_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    found = repetition.quality(documents(spark, sf_dir))
    covered = [F.col("covered")[i].alias(f"covered_{n}") for i, n in enumerate(repetition.MOST_COVERED)]
    return found.select(*[c for c in found.columns if c != "covered"], *covered)


def op6_recompression_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without passages of 20 words that came before."""
    left = recompression.remove_repeats(documents(spark, sf_dir), window=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op7_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a network trained on three quarters of them."""
    docs = documents(spark, sf_dir)
    net = language.fit(docs.filter(~language.held_out()).select("doc_id", "text", "lang"))
    return language.predict(docs, net).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards, and where they go with one shard more."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    payload = [
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    ]
    placed = sharding.shard_rows(docs, "doc_id", [1.0] * 24, grown=[1.0] * 25, payload=payload)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def byte_bpe() -> str:
    """The tokenizer file of the machine that calls."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, starts and checksums of every document, read back from record files."""
    read = records.encoded_documents(documents(spark, sf_dir), byte_bpe, digest=True)
    return read.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op10_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in every document, by greedy string tiling."""
    return tiling.contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))


def op11_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a network trained on the labels of three quarters of them."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet").filter(~quality_net.held_out())
    net = quality_net.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality_net.score(docs, net).select("doc_id", quality_net.held_out().alias("held_out"), "score", "predicted")


def op12_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four leading components of the distinct vectors' covariance."""
    ship(spark)
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    rows = whitening.whiten(vectors, whitening.fit(vectors))
    return rows.withColumn("deviation", F.expr("try_cast(deviation as long)"))


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return search.ranked_search(documents(spark, sf_dir), benchmark(spark, sf_dir), top=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree_scores": op1_suffix_tree_scores,
    "op2_minhash_near_duplicates": op2_minhash_near_duplicates,
    "op3_mix_sources": op3_mix_sources,
    "op4_anchor_pii": op4_anchor_pii,
    "op5_repetition_rules": op5_repetition_rules,
    "op6_recompression_repeats": op6_recompression_repeats,
    "op7_byte_gru_language": op7_byte_gru_language,
    "op8_rendezvous_shards": op8_rendezvous_shards,
    "op9_token_records": op9_token_records,
    "op10_benchmark_tiling": op10_benchmark_tiling,
    "op11_byte_cnn_quality": op11_byte_cnn_quality,
    "op12_jacobi_davidson_whitening": op12_jacobi_davidson_whitening,
    "op13_block_max_search": op13_block_max_search,
}
