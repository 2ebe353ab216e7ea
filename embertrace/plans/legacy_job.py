"""The older scoring of log events as one job: look back, score, write."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.operators.legacy import legacy_scores, look_back
from embertrace.session import cut
from embertrace.sources.tables import replace_partitions


def score_logs(
    logs: DataFrame, as_of: datetime, path: str, run_id: str, *, hours: int = 24, method: str = "isolation_forest", key: str = "alert_id"
) -> dict[str, int]:
    """Score the log events of the last ``hours`` and store them with their score under ``path``.

    A repeated run replaces its own rows and no others.  A span without events writes nothing.  The look-back
    is taken once, so events that arrive meanwhile are in neither the fit nor the output.
    """
    rows = cut(look_back(logs, as_of, hours))
    if rows.isEmpty():
        return {"scored": 0}
    scores = legacy_scores(rows, method, key=key).withColumnRenamed("model", "method")
    scored = rows.drop("anomaly_score", "method").join(scores, key).withColumn("run_id", F.lit(run_id))
    return {"scored": replace_partitions(scored, path, "run_id")}
