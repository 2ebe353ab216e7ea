"""Detection coverage: executed steps against the anomalies that followed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace.functions.text import first_usable
from embertrace.operators.interval import best_in_span, top_in_span


_STEP = ("technique_id", "ability_name", "host", "executed_at", "status")


def step_columns(links: DataFrame, *more: Column) -> DataFrame:
    """Executed links with technique, ability, host and time; unreadable times are null."""
    technique = first_usable(
        F.col("ability.technique_id"),
        F.concat(F.lit("unknown:"), first_usable(F.col("ability.name"), F.col("id"), F.lit("?"))),
    )
    return links.filter(F.col("status").isin(*fv.EXECUTED_STATUS)).select(
        F.col("id").alias("link_id"),
        technique.alias("technique_id"),
        F.coalesce(F.col("ability.name"), F.lit("(unknown)")).alias("ability_name"),
        F.lower(first_usable(F.col("host"), F.col("paw"), F.lit("unknown"))).alias("host"),
        F.try_to_timestamp(first_usable(F.col("finish"), F.col("create"))).alias("executed_at"),
        F.col("status"),
        *more,
    )


def executed_steps(links: DataFrame, poll_order: Column | None = None) -> DataFrame:
    """Executed steps, one row per link.

    A link seen in several polls counts once, as it was first seen executed.  Steps whose
    time cannot be read are left out.
    """
    seen = poll_order if poll_order is not None else first_usable(F.col("finish"), F.col("create"))
    shaped = step_columns(links, seen.alias("_seen"))
    first = F.min_by(F.struct(*_STEP), F.struct("_seen", "status", "executed_at"))
    return (
        shaped.groupBy("link_id")
        .agg(first.alias("s"))
        .select("link_id", "s.*")
        .filter(F.col("executed_at").isNotNull())
    )


def anomalous_events(scores: DataFrame, min_score: float) -> DataFrame:
    """Anomalies at or above a score, with the columns the step join needs."""
    return scores.filter(F.col("ml.is_anomaly") & (F.col("ml.anomaly_score") >= min_score)).select(
        F.lower("host.name").alias("host"),
        F.col("ts").alias("event_ts"),
        "alert_id",
        F.col("ml.anomaly_score").alias("score"),
        F.col("ml.anomaly_percentile").alias("percentile"),
    )


def step_results(
    steps: DataFrame, anomalies: DataFrame, window_seconds: int = fv.DETECTION_WINDOW_SECONDS, shown: int = 10
) -> DataFrame:
    """Every step with what was detected on its host within the window after it.

    ``detecting_events`` stops at ``shown`` as a report figure; ``all_detecting_events`` is
    the full number.  ``best_latency_s`` belongs to the highest score, ``first_latency_s``
    to the earliest event.
    """
    best = best_in_span(
        steps, anomalies, "link_id", window_seconds, step_at="executed_at", event_at="event_ts"
    )
    return step_report(steps.join(best, "link_id", "left"), shown)


def step_report(found_steps: DataFrame, shown: int = 10) -> DataFrame:
    """Report columns of steps with ``n`` (null: none), ``first_at`` and ``best`` of their window."""
    found = F.col("n").isNotNull()
    seconds = lambda micros: F.when(
        found, F.round(F.greatest(micros - F.unix_micros("executed_at"), F.lit(0)) / 1e6, 1)
    )
    total = F.coalesce("n", F.lit(0))
    return found_steps.select(
        "link_id",
        "technique_id",
        "ability_name",
        "host",
        "executed_at",
        found.alias("detected"),
        F.round(F.coalesce("best.score", F.lit(0.0)), 4).alias("max_score"),
        F.round("best.percentile", 2).alias("max_percentile"),
        seconds(-F.col("best.before")).alias("best_latency_s"),
        seconds(F.col("first_at")).alias("first_latency_s"),
        F.least(total, F.lit(shown)).alias("detecting_events"),
        total.alias("all_detecting_events"),
    )


def top_detections(
    steps: DataFrame, anomalies: DataFrame, window_seconds: int = fv.DETECTION_WINDOW_SECONDS, k: int = 10
) -> DataFrame:
    """The best detections of each step, ranked by score."""
    return top_in_span(
        steps, anomalies, "link_id", window_seconds, k, step_at="executed_at", event_at="event_ts"
    )


def scorecard(results: DataFrame) -> DataFrame:
    """One row: executed, detected, missed, rate and mean latency of the detections."""
    n, hit = F.count(F.lit(1)), F.count_if("detected")
    return results.agg(
        n.alias("techniques_executed"),
        hit.alias("detected"),
        (n - hit).alias("missed"),
        F.when(n > 0, F.round(hit / F.nullif(n, F.lit(0)), 4)).otherwise(F.lit(0.0)).alias("detection_rate"),
        F.round(F.avg(F.when(F.col("detected"), F.col("best_latency_s"))), 1).alias("avg_detection_latency_seconds"),
    )


def missed_techniques(results: DataFrame) -> DataFrame:
    """Techniques with undetected steps: how many, and the ability of the first one."""
    return (
        results.filter(~F.col("detected"))
        .groupBy("technique_id")
        .agg(
            F.count(F.lit(1)).alias("missed_steps"),
            F.min_by("ability_name", F.struct("executed_at", "link_id")).alias("ability_name"),
        )
    )


def detection_split(results: DataFrame) -> DataFrame:
    """Number of detected and of missed steps."""
    status = F.when(F.col("detected"), F.lit("Detected")).otherwise(F.lit("Missed"))
    return results.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("steps"))


def step_table(results: DataFrame) -> DataFrame:
    """Report rows: a missed step shows no score."""
    return results.select(
        "technique_id",
        "ability_name",
        "host",
        "detected",
        F.when(F.col("detected"), F.col("max_score")).alias("max_score"),
        F.col("best_latency_s").alias("latency_s"),
        F.col("detecting_events").alias("events"),
        "link_id",
    )


def tactic_coverage(results: DataFrame, tactic: Column) -> DataFrame:
    """Distinct techniques per tactic, those detected at least once, and the gap."""
    per_technique = results.groupBy(tactic.alias("tactic"), "technique_id").agg(
        F.max(F.col("detected").cast("int")).alias("hit")
    )
    return per_technique.groupBy("tactic").agg(
        F.count(F.lit(1)).alias("techniques"),
        F.sum("hit").alias("covered"),
        (F.count(F.lit(1)) - F.sum("hit")).alias("gap"),
    )
