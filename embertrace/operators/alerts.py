"""The alert tables: current state, queues, payloads and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from embertrace import fixed_values as fv
from embertrace.operators.ranking import top_rows
from embertrace.session import cut


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Newest row per key."""
    others = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*others), newest_order(rows.select(*others).schema, at))
    return rows.groupBy(key).agg(newest.alias("r")).select(key, "r.*")


def newest_order(fields: StructType, at: str, prefix: str = "") -> Column:
    """What orders rows in time: ``at``, and at equal times the other columns that have an order."""
    plain = {"string", "double", "integer", "long", "boolean", "timestamp"}
    others = [f.name for f in fields if f.name != at and f.dataType.typeName() in plain]
    return F.struct(*[F.col(f"{prefix}{c}") for c in (at, *others)])


def newest_scores(scores: DataFrame) -> DataFrame:
    """The row of the newest run for every alert; runs are told apart by ``scored_at`` and ``run_id``."""
    if "run_id" not in scores.columns:
        return scores
    others = [c for c in scores.columns if c != "alert_id"]
    newest = F.max_by(F.struct(*others), F.struct("ml.scored_at", "run_id"))
    return scores.groupBy("alert_id").agg(newest.alias("r")).select("alert_id", "r.*")


def newest_top(scores: DataFrame, chosen: Column, limit: int, look_at: int | None = None) -> DataFrame:
    """The ``limit`` highest of the newest rows that satisfy ``chosen``, without shuffling the scores.

    The highest rows of all runs are taken first, then the newest rows of just these alerts are
    looked up in one scan; rows that a newer run replaced fall out.  If too few are left, more
    rows are taken.
    """
    order = [F.desc("ml.anomaly_score"), F.col("alert_id")]
    if "run_id" not in scores.columns:
        return top_rows(scores.filter(chosen), limit, *order)
    take = look_at or 4 * limit
    while True:
        narrow = scores.filter(chosen).select("alert_id", "run_id", "ml.anomaly_score", "ml.scored_at")
        highest = cut(top_rows(narrow, take, F.desc("anomaly_score"), F.col("alert_id"), F.desc("run_id")))
        ids = highest.select("alert_id").distinct()
        # As many ids as rows were taken: a few hundred unless old runs scored far higher.
        few = F.broadcast(ids) if take <= _BROADCAST_IDS else ids
        newest = newest_scores(scores.join(few, "alert_id", "left_semi"))
        taken = highest.select("alert_id", "run_id", F.lit(True).alias("_taken")).distinct()
        standing = cut(newest.join(taken, ["alert_id", "run_id"]).filter(chosen).drop("_taken"))
        if highest.count() < take or standing.count() >= limit:
            return top_rows(standing, limit, *order)
        take *= 4


_BROADCAST_IDS = 100_000


def current_alerts(scores: DataFrame, triage: DataFrame, notifications: DataFrame) -> DataFrame:
    """The newest score of every alert with its latest triage and whether a notification went out."""
    scores = newest_scores(scores)
    newest = latest(triage, "alert_id", "enriched_at").select(
        "alert_id", F.struct(*[c for c in triage.columns if c != "alert_id"]).alias("triage")
    )
    sent = (
        notifications.filter(F.col("status") == "sent").groupBy("alert_id").agg(F.max("ts").alias("notified_at"))
    )
    return state_columns(scores.join(newest, "alert_id", "left").join(sent, "alert_id", "left"))


def state_columns(rows: DataFrame) -> DataFrame:
    """What is read off an alert's score, triage and ``notified_at``."""
    return (
        rows.withColumn("enriched", F.col("triage").isNotNull())
        .withColumn("notified", F.col("notified_at").isNotNull())
        .withColumn("score_routing", F.col("ml.routing_decision"))
        .withColumn("fused_routing", F.col("triage.routing_decision"))
    )


def alert_queue(alerts: DataFrame, threshold: float = 0.70, limit: int | None = 100) -> DataFrame:
    """Flat queue rows at or above a score, highest first."""
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    chosen = top_rows(
        alerts.filter(F.col("ml.anomaly_score") >= threshold), limit, F.desc("ml.anomaly_score"), F.col("alert_id")
    )
    return chosen.select(
        "alert_id",
        F.round("ml.anomaly_score", 4).alias("score"),
        F.col("ml.anomaly_percentile").alias("percentile"),
        F.col("triage.combined_confidence").alias("combined"),
        F.coalesce("fused_routing", "score_routing", F.lit("—")).alias("routing"),
        F.coalesce("triage.if_llm_disagreement", F.lit(False)).alias("disagreement"),
        "enriched",
        text("event.category").alias("category"),
        text("process.name").alias("process"),
        text("process.parent.name").alias("parent"),
        text("user.name").alias("user"),
        text("host.name").alias("host"),
        text("source_dataset").alias("dataset"),
    )


def disagreement_queue(queue: DataFrame) -> DataFrame:
    """Queue rows where model and reply disagree."""
    return queue.filter("disagreement").select(
        "alert_id", "score", "percentile", "combined", "routing", "category", "process", "dataset"
    )


def anomaly_top(alerts: DataFrame, limit: int = 10) -> DataFrame:
    """Highest-scoring anomalies with their triage labels."""
    return top_rows(
        alerts.filter(F.col("ml.is_anomaly")), limit, F.desc("ml.anomaly_score"), F.col("alert_id")
    ).select(
        "alert_id",
        F.col("ml.anomaly_score").alias("score"),
        F.col("process.name").alias("process"),
        F.col("event.category").alias("category"),
        F.col("source_dataset").alias("dataset"),
        F.col("triage.attack_technique").alias("technique"),
        F.col("triage.fp_assessment").alias("fp"),
    )


def score_preview(alerts: DataFrame, limit: int = 10) -> DataFrame:
    """Highest scores of a run, flagged or not: what a trial run shows instead of writing."""
    return top_rows(alerts, limit, F.desc("ml.anomaly_score"), F.col("alert_id")).select(
        "alert_id",
        F.round("ml.anomaly_score", 4).alias("score"),
        F.col("ml.is_anomaly").alias("is_anomaly"),
        F.coalesce("event.category", F.lit("?")).alias("category"),
        F.coalesce("process.name", F.lit("?")).alias("process"),
        F.coalesce("source_dataset", F.lit("?")).alias("dataset"),
    )


def log_triage_input(log_events: DataFrame, threshold: float = 0.75, limit: int = 10) -> DataFrame:
    """Highest-scoring log events at or above a score."""
    columns = ["timestamp", "source_ip", "event_type", "raw", "anomaly_score"]
    return top_rows(
        log_events.filter(F.col("anomaly_score") >= threshold),
        limit,
        F.desc("anomaly_score"),
        F.col("timestamp"),
        F.col("source_ip"),
        F.col("raw"),
    ).select(*columns)


def pending_notifications(alerts: DataFrame, limit: int | None = 200) -> DataFrame:
    """Routed alerts not sent yet, highest confidence first, those without one last."""
    route = F.coalesce("fused_routing", "score_routing")
    waiting = alerts.filter(route.isin(*fv.NOTIFY_ROUTES) & ~F.col("notified"))
    return top_rows(waiting, limit, F.desc_nulls_last("triage.combined_confidence"), F.col("alert_id"))


def payload(alerts: DataFrame, table_name: str) -> DataFrame:
    """The message per alert: eight lifted fields and the alert itself, as JSON."""
    whole = F.struct(*[c for c in alerts.columns if c not in ("enriched", "notified", "notified_at")])
    lifted = {
        "alert_id": F.col("alert_id"),
        "es_index": F.lit(table_name),
        "routing_decision": F.coalesce("fused_routing", "score_routing"),
        "combined_confidence": F.col("triage.combined_confidence"),
        "anomaly_score": F.col("ml.anomaly_score"),
        "enrichment_path": F.col("triage.enrichment_path"),
        "timestamp": F.col("ts"),
        "host": F.col("host.name"),
    }
    body = F.struct(*[value.alias(name) for name, value in lifted.items()], whole.alias("alert"))
    return alerts.select(
        *[value.alias(name) for name, value in lifted.items()],
        F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"),
    )


def notification_rows(pending: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """Log rows for delivered and failed messages; ``outcomes`` holds ``alert_id, ok``."""
    return pending.join(outcomes.select("alert_id", "ok"), "alert_id").select(
        "alert_id",
        at.alias("ts"),
        F.coalesce("fused_routing", "score_routing").alias("routing_decision"),
        F.col("triage.combined_confidence").alias("combined_confidence"),
        F.when(F.col("ok"), F.lit("sent")).otherwise(F.lit("failed")).alias("status"),
    )


def notification_summary(fetched: DataFrame, log_rows: DataFrame) -> DataFrame:
    """One row: alerts fetched, sent, failed (and never sent), and fetched but not attempted."""
    tried = log_rows.groupBy("alert_id").agg(
        F.when(F.bool_or(F.col("status") == "sent"), "sent").otherwise("failed").alias("status")
    )
    outcome = fetched.select("alert_id").distinct().join(tried, "alert_id", "left")
    return outcome.agg(
        F.count(F.lit(1)).alias("total_fetched"),
        F.count_if(F.coalesce(F.col("status") == "sent", F.lit(False))).alias("sent"),
        F.count_if(F.coalesce(F.col("status") == "failed", F.lit(False))).alias("failed"),
        F.count_if(F.col("status").isNull()).alias("skipped"),
    )


def key_figures(alerts: DataFrame) -> DataFrame:
    """One row: totals, score statistics and guarded ratios."""
    score = F.col("ml.anomaly_score")
    total, anomalies, enriched = F.count(score), F.count_if(F.col("ml.is_anomaly")), F.count_if("enriched")
    return alerts.agg(
        total.alias("total_events"),
        anomalies.alias("anomalies"),
        enriched.alias("enriched"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        F.avg(score).alias("avg_score"),
        F.sum(score).alias("sum_score"),
        (anomalies * 100.0 / F.greatest(total, F.lit(1))).alias("anomaly_pct"),
        (enriched * 100.0 / F.greatest(anomalies, F.lit(1))).alias("enriched_pct"),
    )
