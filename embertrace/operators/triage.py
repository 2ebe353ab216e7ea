"""Triage of alerts: what to ask, how a reply is read, and the fused confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace.functions import prompts
from embertrace.functions.replies import parsed_reply
from embertrace.functions.scoring import (
    combined_confidence_raw,
    disagreement,
    fused_route,
    reply_confidence,
)
from embertrace.functions.text import first_usable, group_tactic, strip
from embertrace.operators.ranking import top_rows


def rule_backed(rule_id: Column) -> Column:
    """True when a rule stands behind the alert."""
    return F.coalesce(strip(rule_id) != "", F.lit(False))


def unenriched(scores: DataFrame, triage: DataFrame, limit: int | None = None) -> DataFrame:
    """Anomalies without triage, highest score first."""
    open_alerts = scores.filter(F.col("ml.is_anomaly")).join(triage.select("alert_id"), "alert_id", "left_anti")
    return top_rows(open_alerts, limit, F.desc("ml.anomaly_score"), F.col("alert_id"))


def prompt_table(alerts: DataFrame) -> DataFrame:
    """``alert_id, enrichment_path, prompt``: the input of a batch inference job."""
    backed = rule_backed(F.col("wazuh.rule.id"))
    return alerts.select(
        "alert_id",
        F.when(backed, F.lit("A")).otherwise(F.lit("B")).alias("enrichment_path"),
        F.when(backed, prompts.rule_prompt()).otherwise(prompts.full_prompt()).alias("prompt"),
    )


def confidence_columns(score: Column, percentile: Column, label: Column) -> list[Column]:
    """Fused confidence, reply confidence, disagreement and route."""
    confidence = reply_confidence(label)
    combined = combined_confidence_raw(score, percentile, confidence)
    return [
        F.round(combined, 4).alias("combined_confidence"),
        F.round(confidence, 2).alias("llm_confidence"),
        disagreement(score, confidence).alias("if_llm_disagreement"),
        fused_route(combined).alias("routing_decision"),
    ]


def read_replies(alerts: DataFrame, responses: DataFrame) -> DataFrame:
    """Alerts with their reply, one row per reply: parsed fields, or null ``reply``."""
    backed = rule_backed(F.col("wazuh.rule.id"))
    return alerts.join(responses.select("alert_id", "raw_response"), "alert_id").withColumn(
        "reply", parsed_reply(F.col("raw_response"), backed)
    )


def triage_rows(alerts: DataFrame, responses: DataFrame, enriched_at: Column) -> DataFrame:
    """Rows of the triage table for the alerts whose reply is usable.

    Where a rule stands behind the alert, what the reply leaves out comes from the rule.
    """
    rule = F.col("wazuh.rule")
    backed = rule_backed(rule["id"])
    rule_id = strip(rule["id"])
    known = first_usable(F.col("event.mitre.technique"), F.concat(F.lit("wazuh:"), rule_id))
    described = F.concat(F.lit("Wazuh rule "), rule_id, F.lit(": "), F.coalesce(rule["description"], F.lit("")))
    fill = lambda field, value: F.when(
        backed, F.coalesce(F.col(f"reply.{field}"), value)
    ).otherwise(F.col(f"reply.{field}"))
    score = F.coalesce(F.col("ml.anomaly_score"), F.lit(0.0))
    return (
        read_replies(alerts, responses)
        .filter(F.col("reply").isNotNull())
        .select(
            "alert_id",
            enriched_at.alias("enriched_at"),
            F.when(backed, F.lit("A")).otherwise(F.lit("B")).alias("enrichment_path"),
            fill("attack_technique", known).alias("attack_technique"),
            fill("attack_tactic", group_tactic(rule["groups"])).alias("attack_tactic"),
            fill("description", described).alias("description"),
            F.col("reply.fp_assessment").alias("fp_assessment"),
            F.col("reply.fp_reasoning").alias("fp_reasoning"),
            F.col("reply.investigation_steps").alias("investigation_steps"),
            *confidence_columns(score, F.col("ml.anomaly_percentile"), F.col("reply.fp_assessment")),
        )
    )


def triage_summary(attempted: DataFrame, triage: DataFrame) -> DataFrame:
    """One row: alerts processed, succeeded, failed, and disagreements among them."""
    outcome = attempted.select("alert_id").join(
        triage.select("alert_id", "if_llm_disagreement", F.lit(True).alias("done")), "alert_id", "left"
    )
    return outcome.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.coalesce("done", F.lit(False))).alias("succeeded"),
        F.count_if(F.col("done").isNull()).alias("failed"),
        F.count_if(F.coalesce("if_llm_disagreement", F.lit(False))).alias("disagreements"),
    )


def disagreement_rows(alerts: DataFrame, triage: DataFrame) -> DataFrame:
    """Details of the alerts where model and reply disagree."""
    return triage.filter("if_llm_disagreement").join(
        alerts.select("alert_id", F.col("ml.anomaly_score").alias("score"), F.col("process.name").alias("process")),
        "alert_id",
    ).select("alert_id", "score", "process", "combined_confidence", "attack_technique", "fp_assessment")
