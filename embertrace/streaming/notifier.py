"""Messages for routed alerts as an idempotent sink: what went out is read from the log, not kept in a stream's state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from embertrace import fixed_values as fv
from embertrace.session import scratch_path
from embertrace.sources.tables import replace_partitions

LOG = "batch bigint, alert_id string, attempt int, asked_at timestamp, routing_decision string, combined_confidence double, status string"

#: Messages in, ``alert_id, ok`` out; a message without an outcome was not tried.
Deliver = Callable[[DataFrame], DataFrame]


def notification_log(spark: SparkSession, path: str) -> DataFrame:
    """All attempts so far; none if nothing was ever sent."""
    try:
        return spark.read.schema(LOG).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG)


def due_messages(triage: DataFrame, log: DataFrame) -> DataFrame:
    """One message for each routed alert of ``triage`` that was not sent yet, and for each failed one in the log.

    Of several rows of an alert the newest routed one asks; ``attempt`` goes on counting from the log.
    """
    routed = triage.filter(F.col("routing_decision").isin(*fv.NOTIFY_ROUTES)).select(
        "alert_id", F.lit(0).alias("attempt"), F.col("enriched_at").alias("asked_at"), "routing_decision", "combined_confidence", F.lit(None).cast("string").alias("status")
    )
    tried = log.drop("batch")
    told = F.struct("asked_at", "routing_decision", "combined_confidence")
    return (
        routed.unionByName(tried)
        .groupBy("alert_id")
        .agg(
            (F.max("attempt") + 1).cast("int").alias("attempt"),
            F.max_by(told, told).alias("told"),
            F.bool_or(F.coalesce(F.col("status") == "sent", F.lit(False))).alias("sent"),
        )
        .filter(~F.col("sent"))
        .select("alert_id", "attempt", "told.*")
    )


def notify_batch(triage: DataFrame, batch_id: int, log_path: str, deliver: Deliver) -> int:
    """Deliver what is due and log it under the batch's number; says how many attempts were made.

    A batch that comes again, after a restart, finds its own attempts in the log and does nothing; one that died
    between delivery and log delivers again, as nobody knows which messages had arrived.
    """
    spark = triage.sparkSession
    log = notification_log(spark, log_path)
    if not log.filter(F.col("batch") == batch_id).isEmpty():
        return 0
    # delivering is no transformation: it must happen once, so its outcomes are written before they are joined
    messages, outcomes = scratch_path(spark, "messages"), scratch_path(spark, "outcomes")
    due_messages(triage, log).write.parquet(messages)
    due = spark.read.parquet(messages)
    deliver(due).select("alert_id", "ok").write.parquet(outcomes)
    tried = due.join(spark.read.schema("alert_id string, ok boolean").parquet(outcomes), "alert_id")
    status = F.when(F.col("ok"), F.lit("sent")).otherwise(F.lit("failed"))
    rows = tried.select(
        F.lit(batch_id).cast("bigint").alias("batch"), "alert_id", "attempt", "asked_at", "routing_decision", "combined_confidence", status.alias("status")
    )
    return replace_partitions(rows, log_path, "batch")


def notify_stream(triage: DataFrame, log_path: str, deliver: Deliver, checkpoint: str) -> StreamingQuery:
    """Notify for a stream of triage rows until it has caught up."""
    return (
        triage.writeStream.foreachBatch(lambda rows, batch_id: notify_batch(rows, batch_id, log_path, deliver) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
