"""File streams into the event tables: endpoint alerts and log lines."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from embertrace.operators.ledger import run_row
from embertrace.operators.normalise import endpoint_alerts, log_lines, parsed_alerts, rejected_alerts
from embertrace.session import scratch_path
from embertrace.sources.tables import replace_partitions


def text_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New lines of the files under a path or glob; unreadable files are passed over."""
    reader = spark.readStream.format("text").option("ignoreCorruptFiles", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(F.col("value").alias("line"))


def alert_events(lines: DataFrame) -> DataFrame:
    """A stream of alert lines as canonical events; unusable lines drop out."""
    return endpoint_alerts(lines)


def log_events(lines: DataFrame, ingested_at: Column) -> DataFrame:
    """A stream of log lines as log events."""
    return log_lines(lines, ingested_at)


def run_available(rows: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> StreamingQuery:
    """Append what is new since the last run to a table, then stop.

    The checkpoint is the cursor: every input file is taken once, also across restarts.
    """
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy(*(partition_by or []))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def bridge_batch(lines: DataFrame, batch_id: int, folder: str) -> dict[str, int]:
    """Events, rejected lines and the run record of one batch, each under the batch's number; lines are parsed once.

    A batch that comes again replaces what it wrote.  The record comes last and has the counts.
    """
    spark, started = lines.sparkSession, datetime.now(timezone.utc)
    staged = scratch_path(spark, "parsed")
    parsed = parsed_alerts(lines)
    parsed.write.parquet(staged)
    parsed = spark.read.schema(parsed.schema).parquet(staged)
    number = F.lit(batch_id).cast("bigint")
    indexed = replace_partitions(endpoint_alerts(parsed).withColumn("batch", number), f"{folder}/events", "batch")
    skipped = replace_partitions(rejected_alerts(parsed).withColumn("batch", number), f"{folder}/rejected", "batch")
    result = {"indexed": indexed, "skipped": skipped}
    record = run_row(spark, "bridge", started, datetime.now(timezone.utc), json.dumps(result), run_id=f"bridge-{batch_id:010d}")
    replace_partitions(record, f"{folder}/run_ledger", "run_id")
    return result


def bridge_stream(lines: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Take in alert lines until the stream has caught up: ``events``, ``rejected`` and ``run_ledger`` under ``folder``."""
    return (
        lines.writeStream.foreachBatch(lambda rows, batch_id: bridge_batch(rows, batch_id, folder) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
