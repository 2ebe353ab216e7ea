"""From raw documents to shards: quality, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last
adds ``shard`` and ``slot``.  Stages read and write through Spark only.  All of them take tables without rows, repeated
rows, nulls in any column, empty and very long texts, and further columns of any name, which stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.llm.latent import decontaminated
from embertrace.llm.mixing import temperature_mix
from embertrace.llm.odd_sketch import Plan, near_duplicates
from embertrace.llm.quality import quality_rules
from embertrace.llm.sharding import hypergeometric_shards
from embertrace.session import scratch_path


#: Near-duplicates from 80 % on: a pair at that limit shares none of 40 bands of 5 samples with probability
#: (1 - 0.8**5)**40 < 1.3e-7.
NEAR = Plan(percent=80, bands=40, rows=5)


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` beside the whole row, so that no result can replace a column of the input."""
    return docs.select(*columns, F.struct("*").alias("_row"))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep.

    A null or empty text has too few words and goes; equal rows are judged alike; a document without a language is held
    against the references of all languages.
    """
    return quality_rules(_rows(docs, "text", "lang")).filter("kept").select("_row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Rows that share a doc_id are one document, of which any row stays; rows without one stay, and so does a
    document without words, which is like no other.
    """
    first = near_duplicates(docs, NEAR).filter("kept").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no passage of the benchmark.

    A null or empty text holds none; an empty benchmark, or items without words, send nothing away; equal rows go or
    stay together.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminated(_rows(docs, "text"), benchmark).select("_row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture reads it: at least once, and no source more than twice over.

    Rows without a source are a source of their own, rows without words count as they are, and each of several equal rows
    is read on its own.
    """
    return temperature_mix(_rows(docs, "doc_id", "text", "source")).select("_row.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot; equal rows, and rows of nulls, have places of their own.

    Input columns ``shard`` and ``slot`` are replaced.
    """
    return hypergeometric_shards(docs)


STAGES = [
    ("quality rules", good),
    ("near duplicates", distinct),
    ("benchmark decontamination", clean),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL has no shingle sketches, singular vectors or hypergeometric draws; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
