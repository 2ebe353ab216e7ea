"""Train and score: full retrain over all events, and incremental scoring with a saved model."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace import schemas
from embertrace.operators.features import Frequencies, feature_matrix
from embertrace.operators.ledger import last_valid_run, metric_rows, run_row
from embertrace.operators.model import (
    Model,
    batch_scores,
    fit,
    rank_scores,
    raw_scores,
    run_metrics,
    training_scores,
)
from embertrace.session import cut, spread
from embertrace.sources import manifest
from embertrace.sources.tables import append, conform_known


@dataclass(frozen=True)
class Retrained:
    """What a retrain leaves behind."""

    model: Model
    frequencies: Frequencies
    features: DataFrame
    scores: DataFrame


def retrain(
    events: DataFrame,
    model_id: str,
    *,
    contamination: float = fv.CONTAMINATION,
    trees: int = fv.TREES,
    seed: int = fv.SEED,
) -> Retrained:
    """Features, scaler, forest and scores over all events.

    The features are computed once and read three times: scaler, sample, scoring.
    """
    frequencies = Frequencies.count(events)
    features = cut(feature_matrix(events, frequencies))
    model, ranked = fit(features, model_id, contamination=contamination, trees=trees, seed=seed)
    return Retrained(model, frequencies, features, batch_scores(model, ranked))


def score_new(
    model: Model,
    new_events: DataFrame,
    *,
    baseline: str = "batch",
    frequencies: Frequencies | None = None,
) -> DataFrame:
    """Score events with a saved model, without training.

    ``batch``: frequencies, bounds and percentiles come from the new events alone.
    ``training``: they come from the saved training run (``frequencies`` is needed).
    """
    if baseline == "training":
        if frequencies is None:
            raise ValueError("the training baseline needs the saved frequency tables")
        return training_scores(model, feature_matrix(new_events, frequencies))
    if baseline != "batch":
        raise ValueError(f"unknown baseline {baseline!r}")
    features = cut(feature_matrix(new_events))
    ranked = rank_scores(raw_scores(spread(features), model.scaler, model.forest))
    return batch_scores(model, ranked)


def since_last_run(ledger: DataFrame, since=None):
    """The boundary of an incremental run: given, or the end of the last valid retrain."""
    if since is not None:
        return since
    row = last_valid_run(ledger).first()
    if row is None or row["completed_at"] is None:
        raise RuntimeError("no start time given and no successful retrain found")
    return row["completed_at"]


def with_events(events: DataFrame, scores: DataFrame, run_id: Column, scored_at: Column) -> DataFrame:
    """Rows of the scores table: the event without its raw text, plus the ``ml`` struct."""
    ml = [c for c in scores.columns if c != "alert_id"]
    packed = scores.select("alert_id", F.struct(*ml, scored_at.alias("scored_at")).alias("ml"))
    kept = [c for c in events.columns if c not in ("_raw", "_bad_reason")]
    return events.select(*kept).join(packed, "alert_id").withColumn("run_id", run_id)


#: What a run leaves behind; each part is a folder that the run's commit names.
PARTS = ("scores", "feature_snapshot", "model", "run_metrics", "run_ledger")


def store(
    run: Retrained, events: DataFrame, root: str, started_at: datetime, completed_at: datetime
) -> dict[str, int]:
    """Write everything a retrain leaves: scores, feature snapshot, model, metrics and tags, run record.

    All of it becomes visible by one commit, or none of it: a run that dies half-way leaves only folders that
    nobody reads.  A repeated run replaces what it stored before.
    """
    spark = events.sparkSession
    run_id = run.model.model_id
    named = F.lit(run_id).alias("run_id")
    folders = {part: manifest.new_folder(root) for part in PARTS}
    scored = with_events(events, run.scores, F.lit(run_id), F.lit(completed_at))
    written = append(conform_known(scored, schemas.SCORED_EVENT), folders["scores"])
    run.features.select(named, "*").write.parquet(folders["feature_snapshot"])
    run.model.save(spark, folders["model"], run.frequencies)
    settings = spark.createDataFrame(
        [("isolation_forest", run.model.contamination, len(run.model.forest.path), ",".join(fv.FEATURES))],
        "model_type string, contamination double, n_estimators int, feature_names string",
    )
    figures = cut(run_metrics(run.scores))
    rows = metric_rows(F.lit(run_id), "param", settings).unionByName(metric_rows(F.lit(run_id), "metric", figures))
    tags = events.agg(
        F.coalesce(F.array_join(F.sort_array(F.collect_set("source_dataset")), ","), F.lit("")).alias("dataset"),
        F.count(F.lit(1)).alias("event_count"),
    ).withColumn("score_threshold", F.lit(run.model.cut_off))
    rows.unionByName(metric_rows(F.lit(run_id), "tag", tags)).write.parquet(folders["run_metrics"])
    head = figures.first()
    result = {"events_scored": head["events_scored"], "anomalies_found": head["anomaly_count"], "written": written}
    record = run_row(spark, "retrain", started_at, completed_at, json.dumps(result), run_id=run_id)
    record.write.parquet(folders["run_ledger"])
    _publish(spark, root, run_id, folders)
    return result


def store_unfinished(
    spark: SparkSession, run_id: str, root: str, started_at: datetime, ended_at: datetime,
    errors: list[str] | None = None, result: dict | None = None,
) -> None:
    """The record of a run that failed (with ``errors``) or was a trial (without): nothing else is written.

    What an earlier run of the same name stored stays.
    """
    record = run_row(
        spark, "retrain", started_at, ended_at, json.dumps(result or {}), errors, dry_run=not errors, run_id=run_id
    )
    folder = manifest.new_folder(root)
    record.write.parquet(folder)
    _publish(spark, root, run_id, {"run_ledger": folder})


def _publish(spark: SparkSession, root: str, run_id: str, folders: dict[str, str]) -> None:
    """Commit the folders of a run; runs that commit at the same time do not disturb each other."""
    while True:
        head = manifest.newest(spark, root)
        mine = {f"{part}/{run_id}": folder for part, folder in folders.items()}
        try:
            manifest.commit(spark, root, head, (head.folders if head else {}) | mine)
            return
        except manifest.Conflict:
            continue


def stored(spark: SparkSession, root: str, part: str, run_id: str | None = None) -> DataFrame:
    """A part of all stored runs, or of one.  The model is a bundle: see :func:`stored_model`."""
    head = manifest.newest(spark, root)
    found = [f for name, f in sorted((head.folders if head else {}).items()) if name.partition("/")[0] == part and run_id in (None, name.partition("/")[2])]
    if not found:
        raise LookupError(f"no {part} of {run_id or 'any run'} under {root}")
    return spark.read.option("mergeSchema", "true").parquet(*found)


def stored_model(spark: SparkSession, root: str, run_id: str) -> tuple[Model, Frequencies]:
    """The model of a stored run, with the frequency tables it was trained on."""
    head = manifest.newest(spark, root)
    folder = head and head.folders.get(f"model/{run_id}")
    if not folder:
        raise LookupError(f"no model of {run_id} under {root}")
    return Model.load(spark, folder, run_id), Model.load_frequencies(spark, folder, run_id)


def stored_snapshot(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """Feature rows of a stored run: the named one, or the last valid one of the ledger."""
    if run_id is None:
        row = last_valid_run(stored(spark, root, "run_ledger")).first()
        if row is None:
            raise LookupError(f"no valid run under {root}")
        run_id = row["run_id"]
    return stored(spark, root, "feature_snapshot", run_id)


def run_summary(scores: DataFrame) -> DataFrame:
    """Counts of one run; an empty batch gives zeros."""
    return scores.agg(
        F.count(F.lit(1)).alias("events_scored"), F.count_if("is_anomaly").alias("anomalies_found")
    )
