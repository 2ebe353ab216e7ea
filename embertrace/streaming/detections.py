"""Steps and anomalies as two streams, matched in the window after each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace import fixed_values as fv


def new_steps(steps: DataFrame, late: str) -> DataFrame:
    """Each link once, as long as repeats come within the lateness."""
    known = steps.filter(F.col("executed_at").isNotNull())
    return known.withWatermark("executed_at", late).dropDuplicatesWithinWatermark(["link_id"])


def detection_stream(
    steps: DataFrame,
    anomalies: DataFrame,
    window_seconds: int = fv.DETECTION_WINDOW_SECONDS,
    late: str = "10 minutes",
    keep_misses: bool = True,
) -> DataFrame:
    """One row per step and anomaly in its window; a step without any once its window closed.

    A miss comes out when both streams have moved past the end of the window.  The state
    holds only what the watermarks still allow to match.
    """
    s = new_steps(steps, late).alias("s")
    a = anomalies.withWatermark("event_ts", late).alias("a")
    span = F.expr(f"interval {int(window_seconds)} seconds")
    matched = (
        (F.col("s.host") == F.col("a.host"))
        & (F.col("a.event_ts") >= F.col("s.executed_at"))
        & (F.col("a.event_ts") <= F.col("s.executed_at") + span)
    )
    return s.join(a, matched, "leftOuter" if keep_misses else "inner").select(
        "s.link_id",
        "s.technique_id",
        "s.host",
        "s.executed_at",
        F.col("a.alert_id").alias("alert_id"),
        F.col("a.event_ts").alias("event_ts"),
        F.col("a.score").alias("score"),
        F.col("a.alert_id").isNotNull().alias("detected"),
    )
