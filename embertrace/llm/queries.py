"""One query per operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.llm import pii, secret_scan
from embertrace.llm.byte_cnn import identify_languages
from embertrace.llm.latent import benchmark_hits
from embertrace.llm.max_sketch import ranked_documents
from embertrace.llm.mixing import temperature_mix
from embertrace.llm.oracle import LEXICAL_SEARCH, NEAR_DUPLICATES, NEAR_VECTORS, QUALITY, SOURCE_DIVERGENCE
from embertrace.llm.odd_sketch import near_duplicates
from embertrace.llm.preference import PREFERENCE_SQL, conversations_of, formatted, sibling_pairs
from embertrace.llm.quality import quality_rules
from embertrace.llm.quantised_tiles import near_vectors
from embertrace.llm.records import Coding, round_trip
from embertrace.llm.sharding import shard_plan
from embertrace.llm.source_divergence import source_divergence


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as preference pairs with prompt and masked completions."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return formatted(sibling_pairs(conversations_of(turns)))


def op2_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of all documents."""
    return shard_plan(_documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token records of all documents, read back from their files."""
    import public_tokenizers  # only this query needs it

    coding = Coding(public_tokenizers.path("byte_bpe_50k.json"))
    return round_trip(_documents(spark, sf_dir), coding).withColumnRenamed("id", "doc_id")


def op4_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates over all documents."""
    return near_duplicates(_documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op5_latent_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents; a document that holds one is not kept."""
    hits = F.col("hits")
    return benchmark_hits(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id",
        (F.size(hits) == 0).alias("kept"),
        F.array_join(hits["item"].cast("array<string>"), ",").alias("item_ids"),
        F.round(F.array_max(hits["lcs"]), 6).alias("lcs"),
    )


def op6_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that are not held out."""
    return identify_languages(_documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op7_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of every document: pass, block and place in the block."""
    return temperature_mix(_documents(spark, sf_dir)).select("doc_id", "source", "epoch", "block", "place")


def op8_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents and the terms that disclose it."""
    spans = F.col("spans")
    return pii.disclosure_spans(_documents(spark, sf_dir)).select(
        "doc_id",
        *(secret_scan.count_of(spans, kind).alias(f"n_{kind}") for kind in pii.KINDS),
        F.sha2(secret_scan.digest(spans, pii.KINDS), 256).alias("base_sha256"),
        secret_scan.digest(spans).alias("spans"),
    )


def op9_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdicts of all documents."""
    return quality_rules(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_secret_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, in the open and under layers of encoding."""
    spans = F.col("secrets")
    return secret_scan.secret_spans(_documents(spark, sf_dir)).select(
        "doc_id",
        *(secret_scan.count_of(spans, kind).alias(f"n_{kind}") for kind in secret_scan.KINDS),
        F.sha2(secret_scan.digest(spans, secret_scan.KINDS), 256).alias("base_sha256"),
        secret_scan.digest(spans).alias("spans"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and by which terms."""
    return source_divergence(_documents(spark, sf_dir))


def op12_quantised_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate vectors within each label."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


def op13_max_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that score highest for each benchmark item."""
    return ranked_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_preference_pairs": op1_preference_pairs,
    "op2_hypergeometric_shards": op2_hypergeometric_shards,
    "op3_token_records": op3_token_records,
    "op4_odd_sketches": op4_odd_sketches,
    "op5_latent_retrieval": op5_latent_retrieval,
    "op6_byte_network": op6_byte_network,
    "op7_temperature_mix": op7_temperature_mix,
    "op8_disclosure": op8_disclosure,
    "op9_quality_divergence": op9_quality_divergence,
    "op10_secret_layers": op10_secret_layers,
    "op11_source_divergence": op11_source_divergence,
    "op12_quantised_tiles": op12_quantised_tiles,
    "op13_max_sketches": op13_max_sketches,
}

ORACLE: dict[str, str] = {
    "op1_preference_pairs": PREFERENCE_SQL,
    "op4_odd_sketches": NEAR_DUPLICATES,
    "op9_quality_divergence": QUALITY,
    "op11_source_divergence": SOURCE_DIVERGENCE,
    "op12_quantised_tiles": NEAR_VECTORS,
    "op13_max_sketches": LEXICAL_SEARCH,
}
