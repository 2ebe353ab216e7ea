"""Writers of the append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from embertrace import schemas


def conform(rows: DataFrame, schema: str) -> DataFrame:
    """Rows in the declared columns and types; columns they lack are null, extra ones go."""
    wanted = StructType.fromDDL(schema)
    empty = rows.sparkSession.createDataFrame([], wanted)
    extra = [c for c in rows.columns if c not in wanted.fieldNames()]
    merged = rows.drop(*extra).unionByName(empty, allowMissingColumns=True)
    return merged.to(wanted)


def conform_known(rows: DataFrame, schema: str) -> DataFrame:
    """Rows with the declared columns first and in the declared types; further columns stay as they are."""
    declared = StructType.fromDDL(schema).fieldNames()
    others = [c for c in rows.columns if c not in declared]
    wanted = StructType.fromDDL(schema)
    for c in others:
        wanted = wanted.add(rows.schema[c])
    empty = rows.sparkSession.createDataFrame([], wanted)
    return rows.unionByName(empty, allowMissingColumns=True).select(*declared, *others).to(wanted)


def create_if_absent(spark: SparkSession, name: str, schema: str, partition_by: list[str] | None = None) -> None:
    """A catalog table with the declared schema, unless it is there."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], StructType.fromDDL(schema)).write.partitionBy(*(partition_by or [])).saveAsTable(
            name, format="parquet"
        )


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None, format: str = "parquet") -> int:
    """Append rows and say how many were written."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("append").format(format).partitionBy(*(partition_by or [])).save(path)
    return seen.get["rows"]


def append_events(events: DataFrame, path: str) -> int:
    """Events in their declared form, one folder per day."""
    return append(conform_known(events, schemas.EVENT), path, ["event_date"])


def append_triage(rows: DataFrame, path: str) -> int:
    """Triage rows in their declared form."""
    return append(conform(rows, schemas.TRIAGE), path)


def write_scores(scored: DataFrame, path: str) -> int:
    """Scored rows in their declared form, one folder per run; a repeated run replaces its own."""
    return replace_partitions(conform_known(scored.drop("_raw"), schemas.SCORED_EVENT), path, "run_id")


def replace_partitions(rows: DataFrame, path: str, by: str) -> int:
    """Write rows, replacing only the values of ``by`` that occur in them, and say how many were written."""
    seen = Observation()
    counted = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return seen.get["rows"]


def write_scorecard(summary: DataFrame, results: DataFrame, path: str, report_date: str) -> None:
    """Scorecard and its steps of one day; the same day is replaced."""
    day = F.lit(report_date)
    replace_partitions(summary.withColumn("report_date", day), f"{path}/summary", "report_date")
    replace_partitions(results.withColumn("report_date", day), f"{path}/steps", "report_date")


def write_snapshot(features: DataFrame, path: str, run_id: str) -> None:
    """Training features, kept for drift checks."""
    replace_partitions(features.withColumn("run_id", F.lit(run_id)), path, "run_id")


def append_log(rows: DataFrame, path: str) -> int:
    """Notification log as JSON lines, in its declared form."""
    return append(conform(rows, schemas.NOTIFICATION), path, format="json")
