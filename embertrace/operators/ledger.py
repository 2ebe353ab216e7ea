"""Run records: one row per run, and the boundary they give."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace import schemas


def last_valid_run(ledger: DataFrame, job_type: str = "retrain") -> DataFrame:
    """The newest finished run of a job that was no trial and had no errors (one row)."""
    valid = ledger.filter(
        (F.col("job_type") == job_type)
        & ~F.coalesce("dry_run", F.lit(False))
        & (F.coalesce(F.size("errors"), F.lit(0)) <= 0)
        & F.col("completed_at").isNotNull()
    )
    newest = valid.agg(F.max_by(F.struct("run_id", "completed_at"), F.struct("completed_at", "run_id")).alias("r"))
    return newest.filter(F.col("r").isNotNull()).select("r.run_id", "r.completed_at")


def run_row(
    spark: SparkSession,
    job_type: str,
    started_at: datetime,
    completed_at: datetime,
    result: str,
    errors: list[str] | None = None,
    dry_run: bool = False,
    run_id: str | None = None,
) -> DataFrame:
    """One ledger row; without a run id, the start time is one."""
    return spark.createDataFrame(
        [
            (
                run_id or started_at.strftime("%Y%m%d_%H%M%S"),
                job_type,
                started_at,
                completed_at,
                round((completed_at - started_at).total_seconds(), 2),
                dry_run,
                result,
                list(errors or []),
            )
        ],
        schemas.RUN_LEDGER,
    )


def metric_rows(run_id: Column, kind: str, wide: DataFrame) -> DataFrame:
    """Every column of a one-row result as ``run_id, kind, key, value`` rows."""
    pairs = [F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in wide.columns]
    return wide.select(run_id.alias("run_id"), F.lit(kind).alias("kind"), F.inline(F.array(*pairs)))
