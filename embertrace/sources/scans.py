"""Scans of the event, alert and audit tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace import schemas
from embertrace.operators.ledger import last_valid_run


def all_events(events: DataFrame, max_events: int | None = None) -> DataFrame:
    """Every event without its raw text; uncapped unless asked."""
    rows = events.drop("_raw")
    return rows if max_events is None else rows.limit(max_events)


def events_since(events: DataFrame, since: datetime | None, max_events: int | None = None) -> DataFrame:
    """Events strictly after ``since`` (all of them for None), without their raw text.

    On a table partitioned by day the date bound prunes partitions.
    """
    rows = events
    if since is not None:
        rows = rows.filter(F.col("ts") > F.lit(since))
        if "event_date" in events.columns:
            rows = rows.filter(F.col("event_date") >= F.to_date(F.lit(since)))
    return all_events(rows, max_events)


def events_last_days(events: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """The current window of a drift check."""
    return events_since(events, as_of - timedelta(days=days))


def recent_rows(rows: DataFrame, ts: str = "ts", limit: int = 500, *tie: str) -> DataFrame:
    """The newest rows, newest first."""
    return rows.orderBy(F.desc(ts), *tie).limit(limit)


def alert_lines(spark: SparkSession, since: datetime | None, *paths: str) -> DataFrame:
    """Alert lines of all matching daily files, newer than ``since``; no files give no rows."""
    try:
        lines = spark.read.text(list(paths)).select(F.col("value").alias("line"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "line string")
    if since is None:
        return lines
    stamp = F.coalesce(
        F.nullif(F.get_json_object("line", "$['@timestamp']"), F.lit("")), F.get_json_object("line", "$.timestamp")
    )
    return lines.filter(F.try_to_timestamp(stamp) > F.lit(since))


def run_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Run records from JSON files, one object per file; unreadable ones are left out."""
    return (
        spark.read.schema(schemas.RUN_LEDGER)
        .option("multiLine", "true")
        .option("mode", "DROPMALFORMED")
        .json(list(paths))
    )


def latest_scorecard(scorecards: DataFrame) -> DataFrame:
    """The scorecard of the newest report date (one row)."""
    return scorecards.agg(F.max_by(F.struct(*scorecards.columns), "report_date").alias("s")).filter(
        F.col("s").isNotNull()
    ).select("s.*")


def feature_snapshot(spark: SparkSession, path: str, run_id: str | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """Feature rows of a training run: the named one, or the last valid one of the ledger.

    Run ids are free names, so without a ledger there must be a name.
    """
    table = spark.read.parquet(path)
    if run_id is None:
        if ledger is None:
            raise ValueError("the newest snapshot is known to the run ledger only")
        row = last_valid_run(ledger).first()
        if row is None:
            return table.limit(0)
        run_id = row["run_id"]
    return table.filter(F.col("run_id") == run_id)
