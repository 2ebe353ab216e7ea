"""The current state of all alerts as a maintained table.

Alerts lie in buckets by a hash of their id.  New scores, triage rows and notifications are merged into the buckets
that hold their alerts, and only these are read and written again; a commit then names the new folders.  Merging
keeps the newest of what it meets, so rows that come twice, late or out of order change nothing.  The commit
keeps high-water marks of the three inputs, from which the next refresh reads on.

A bucket that has much to merge is merged in pieces, so what a task holds does not grow with the table.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType, TimestampType

from embertrace.operators.alerts import newest_order, state_columns
from embertrace.session import scratch_path
from embertrace.sources import manifest

BUCKETS = 64
#: A task merges about this many rows, old ones and new ones.
TASK_ROWS = 100_000


class AlertState:
    """The table under ``root``; ``buckets`` is fixed when it is made, by the size a bucket shall have."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets

    def read(self) -> DataFrame:
        """Every scored alert: its newest score, latest triage and whether a notification went out."""
        head = manifest.newest(self.spark, self.root)
        if head is None:
            raise ValueError(f"no alert state under {self.root}")
        return state_columns(self._rows(head, head.folders).filter("_scored").drop("_scored"))

    def refresh(self, scores: DataFrame, triage: DataFrame, notifications: DataFrame) -> manifest.Commit:
        """Merge what the three tables hold from the high-water marks on (all of it at first)."""
        head = manifest.newest(self.spark, self.root)
        marks = head.marks if head else {}

        def from_mark(rows: DataFrame, at: str) -> DataFrame:
            mark = marks.get(at)
            return rows if mark is None else rows.filter(F.col(at) >= F.lit(datetime.fromtimestamp(int(mark) / 1e6, timezone.utc)))

        # rows at the mark itself are read again: others of the same instant may have come after it
        return self.apply(from_mark(scores, "ml.scored_at"), from_mark(triage, "enriched_at"), from_mark(notifications, "ts"))

    def apply(self, scores: DataFrame | None = None, triage: DataFrame | None = None, notifications: DataFrame | None = None) -> manifest.Commit:
        """Merge rows of the scores, triage and notification tables into the buckets of their alerts."""
        head = manifest.newest(self.spark, self.root)
        if head is None and (scores is None or triage is None):
            raise ValueError("the first rows must have the columns of scores and of triage")
        schema = StructType.fromJson(json.loads(head.schema)) if head else self._schema(scores, triage)
        delta = self._delta(schema, scores, triage, notifications)
        path = scratch_path(self.spark, "alert-delta")
        delta.write.parquet(path)
        delta = self.spark.read.schema(delta.schema).parquet(path)
        at = ("score.ml.scored_at", "triage.enriched_at", "notified_at")
        names = ("ml.scored_at", "enriched_at", "ts")
        found = delta.agg(F.collect_set("bucket").alias("buckets"), F.count(F.lit(1)).alias("rows"), *[F.unix_micros(F.max(c)).alias(n) for c, n in zip(at, names)]).first()
        if not found["buckets"]:
            return head or manifest.commit(self.spark, self.root, None, {}, {}, schema.json())
        marks = dict(head.marks) if head else {}
        for name in names:
            if found[name] is not None:
                marks[name] = str(max(found[name], int(marks.get(name, found[name]))))
        touched = {str(b) for b in found["buckets"]}
        folders = dict(head.folders) if head else {}
        old = {b: f for b, f in folders.items() if b in touched}
        rows = found["rows"]
        if old:
            before = self._rows(head, old)
            rows += before.count()
            delta = delta.unionByName(self._packed(before, schema))
        pieces = -(-rows // (TASK_ROWS * len(touched)))
        piece = F.pmod(F.xxhash64("alert_id", F.lit("piece")), F.lit(pieces)).alias("piece")
        dealt = delta.select("*", piece).repartition(pieces * len(touched), "bucket", "piece")
        folder = manifest.new_folder(self.root)
        self._merged(dealt, schema).write.partitionBy("bucket").parquet(folder)
        folders |= {b: f"{folder}/bucket={b}" for b in touched}
        return manifest.commit(self.spark, self.root, head, folders, marks, schema.json())

    def _schema(self, scores: DataFrame, triage: DataFrame) -> StructType:
        columns = [f for f in scores.schema if f.name != "alert_id"]
        latest = StructType([f for f in triage.schema if f.name != "alert_id"])
        return StructType(
            [
                StructField("alert_id", StringType()),
                StructField("_scored", BooleanType()),
                *columns,
                StructField("triage", latest),
                StructField("notified_at", TimestampType()),
            ]
        )

    def _rows(self, head: manifest.Commit, folders: dict[str, str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(head.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders.values())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("alert_id"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _score_columns(self, schema: StructType) -> list[str]:
        return [c for c in schema.fieldNames() if c not in ("alert_id", "_scored", "triage", "notified_at")]

    def _packed(self, rows: DataFrame, schema: StructType) -> DataFrame:
        score = F.when(F.col("_scored"), F.struct(*self._score_columns(schema))).alias("score")
        return rows.select(self._bucket(), "alert_id", score, "triage", "notified_at")

    def _delta(self, schema: StructType, scores, triage, notifications) -> DataFrame:
        """The rows as ``bucket, alert_id, score, triage, notified_at``, of which each has one of the last three."""
        columns = self._score_columns(schema)
        empty = self._packed(self.spark.createDataFrame([], schema), schema)
        parts = [empty]
        if scores is not None:
            parts.append(scores.select("alert_id", F.struct(*columns).alias("score")))
        if triage is not None:
            parts.append(triage.select("alert_id", F.struct(*schema["triage"].dataType.fieldNames()).alias("triage")))
        if notifications is not None:
            parts.append(notifications.filter("status = 'sent'").select("alert_id", F.col("ts").alias("notified_at")))
        rows = empty
        for part in parts[1:]:
            rows = rows.unionByName(part.select(self._bucket(), "*"), allowMissingColumns=True)
        return rows

    def _merged(self, rows: DataFrame, schema: StructType) -> DataFrame:
        triage_fields = schema["triage"].dataType
        latest = newest_order(triage_fields, "enriched_at", "triage.")
        merged = rows.groupBy("bucket", "piece", "alert_id").agg(
            F.max_by("score", F.when(F.col("score").isNotNull(), F.struct("score.ml.scored_at", "score.run_id"))).alias("score"),
            F.max_by("triage", F.when(F.col("triage").isNotNull(), latest)).alias("triage"),
            F.max("notified_at").alias("notified_at"),
        )
        scored = F.col("score").isNotNull().alias("_scored")
        return merged.select("bucket", "alert_id", scored, *[F.col("score")[c].alias(c) for c in self._score_columns(schema)], "triage", "notified_at")
