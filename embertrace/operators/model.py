"""The fitted model as a unit, and scoring with it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace.functions.scoring import min_max_inverted, score_route
from embertrace.operators.features import Frequencies
from embertrace.operators.iforest import Forest, fit_trees, one_row
from embertrace.operators.ranking import quantile_columns, value_ranks
from embertrace.operators.scaling import Scaler, scaler_stats, top_features
from embertrace.operators.skew import TableSize, join_counts, table_size
from embertrace.session import cut, spread

# The training percentiles are kept at this many evenly spaced steps.
GRID = 1000
MODEL_NAME = "isolation_forest_v1"


@dataclass(frozen=True)
class Model:
    """Forest, scaler and the training-time numbers that scoring needs."""

    model_id: str
    forest: Forest
    scaler: Scaler
    contamination: float
    cut_off: float
    lo: float
    hi: float
    grid: tuple[float, ...]

    def save(self, spark: SparkSession, path: str, frequencies: Frequencies | None = None) -> None:
        """Write the bundle as tables under one path; they belong together."""
        base = f"{path.rstrip('/')}/{self.model_id}"
        self.forest.slots(spark).coalesce(1).write.mode("overwrite").parquet(f"{base}/trees")
        spark.createDataFrame(
            [(f, self.scaler.n, self.scaler.mean[f], self.scaler.std[f]) for f in fv.FEATURES],
            "feature string, n bigint, mean double, std double",
        ).coalesce(1).write.mode("overwrite").parquet(f"{base}/scaler")
        if frequencies is not None:
            frequencies.table.write.mode("overwrite").parquet(f"{base}/frequencies")
        # Last, so that a bundle with this table is complete.
        one_row(
            spark,
            "model_id string, sample_size int, contamination double, cut_off double, lo double, hi double,"
            " grid array<double>",
            model_id=self.model_id,
            sample_size=self.forest.sample_size,
            contamination=self.contamination,
            cut_off=self.cut_off,
            lo=self.lo,
            hi=self.hi,
            grid=list(self.grid),
        ).coalesce(1).write.mode("overwrite").parquet(f"{base}/model_meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str, model_id: str) -> "Model":
        base = f"{path.rstrip('/')}/{model_id}"
        meta = spark.read.parquet(f"{base}/model_meta").first()
        return cls(
            meta["model_id"],
            Forest.of(spark.read.parquet(f"{base}/trees"), fv.FEATURES, meta["sample_size"]),
            Scaler.of(spark.read.parquet(f"{base}/scaler")),
            meta["contamination"],
            meta["cut_off"],
            meta["lo"],
            meta["hi"],
            tuple(meta["grid"]),
        )

    @staticmethod
    def load_frequencies(spark: SparkSession, path: str, model_id: str) -> Frequencies:
        return Frequencies.of(spark.read.parquet(f"{path.rstrip('/')}/{model_id}/frequencies"))


def raw_scores(features: DataFrame, scaler: Scaler, forest: Forest) -> DataFrame:
    """z-scores plus ``raw``; lower is more anomalous."""
    return forest.score(scaler.z_scores(features))


@dataclass(frozen=True)
class RankedScores:
    """Scored rows and the ranks of their raw scores, both computed."""

    rows: DataFrame
    ranks: DataFrame
    size: TableSize
    n: int
    lo: float
    hi: float


def rank_scores(scored: DataFrame) -> RankedScores:
    """Materialise the raw scores and rank their distinct values once.

    Bounds, cut-off, percentiles and p95 are all read off the ranks.
    """
    rows = cut(scored)
    ranks = cut(value_ranks(rows, "raw"))
    bounds = ranks.agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"),
        F.min("raw").alias("lo"),
        F.max("raw").alias("hi"),
    ).first()
    return RankedScores(rows, ranks, table_size(ranks), bounds["n"], bounds["lo"], bounds["hi"])


def fit(
    features: DataFrame,
    model_id: str,
    *,
    contamination: float = fv.CONTAMINATION,
    trees: int = fv.TREES,
    seed: int = fv.SEED,
) -> tuple[Model, RankedScores]:
    """Fit scaler and forest on computed features, and score them for the cut-off."""
    scaler = Scaler.of(scaler_stats(features))
    if not scaler.n:
        raise ValueError("no events to train on")
    slots, sample_size = fit_trees(
        scaler.z_scores(features), fv.FEATURES, "alert_id", scaler.n, trees=trees, seed=seed
    )
    forest = Forest.of(slots, fv.FEATURES, sample_size)
    ranked = rank_scores(raw_scores(spread(features), scaler, forest))
    steps = [i / GRID for i in range(GRID + 1)]
    cut_off = ranked.ranks.agg(*quantile_columns("raw", [contamination], ["cut_off"])).first()["cut_off"]
    grid = training_grid(ranked.ranks, steps)
    return (
        Model(model_id, forest, scaler, contamination, cut_off, ranked.lo, ranked.hi, grid),
        ranked,
    )


def training_grid(ranks: DataFrame, steps: list[float]) -> tuple[float, ...]:
    """Raw scores at evenly spaced shares of the training rows: at most one row per step."""
    last = len(steps) - 1
    at = lambda position: F.floor(position * F.lit(float(last)) / F.col("cnt_total"))
    # A distinct value answers every step between its first and its last row.
    answers = ranks.select(
        "raw",
        F.ceil(F.col("cnt_below") * F.lit(float(last)) / F.col("cnt_total")).alias("first"),
        at(F.col("cnt_below") + F.col("cnt")).alias("final"),
    ).filter(F.col("first") <= F.col("final"))
    rows = (
        answers.select("raw", F.explode(F.sequence("first", "final")).alias("step"))
        .groupBy("step")
        .agg(F.min("raw").alias("raw"))
        .orderBy("step")
        .collect()
    )
    known = {r["step"]: r["raw"] for r in rows}
    grid, current = [], rows[0]["raw"]
    for step in range(last + 1):
        current = known.get(step, current)
        grid.append(current)
    return tuple(grid)


def batch_scores(model: Model, ranked: RankedScores, **options) -> DataFrame:
    """Scores relative to the scored batch: bounds and percentiles come from its own rows."""
    below = F.col("cnt_total") - F.col("cnt_below") - F.col("cnt")
    ranks = ranked.ranks.select(
        "raw",
        "cnt",
        ((below + (F.col("cnt") + 1) / 2.0) / F.col("cnt_total") * 100.0).alias("percentile"),
    )
    joined = join_counts(
        ranked.rows,
        ranks,
        ["raw"],
        "cnt",
        size=ranked.size,
        total=ranked.n,
        spread_by=F.col("alert_id"),
        **options,
    )
    return _ml_columns(model, joined, F.lit(ranked.lo), F.lit(ranked.hi), F.col("percentile"))


def training_scores(model: Model, features: DataFrame) -> DataFrame:
    """Scores relative to the training rows: no pass over the batch, so it also streams.

    The percentile is read off the saved training grid, to a tenth of a percent.
    """
    scored = raw_scores(features, model.scaler, model.forest)
    grid = np.asarray(model.grid)

    @F.pandas_udf("double")
    def percentile(raw: pd.Series) -> pd.Series:
        above = len(grid) - np.searchsorted(grid, raw.to_numpy(), side="right")
        return pd.Series(np.minimum(above * 100.0 / GRID, 100.0))

    inside = F.least(F.greatest("raw", F.lit(model.lo)), F.lit(model.hi))
    return _ml_columns(
        model, scored, F.lit(model.lo), F.lit(model.hi), percentile(F.col("raw")), placed=inside
    )


def _ml_columns(
    model: Model, rows: DataFrame, lo: Column, hi: Column, percentile: Column, placed: Column | None = None
) -> DataFrame:
    score = min_max_inverted(F.col("raw") if placed is None else placed, lo, hi)
    flagged = F.col("raw") < F.lit(model.cut_off)
    return rows.select(
        "alert_id",
        F.round(score, 6).alias("anomaly_score"),
        F.round(percentile, 2).alias("anomaly_percentile"),
        flagged.alias("is_anomaly"),
        score_route(score, flagged).alias("routing_decision"),
        F.lit(MODEL_NAME).alias("model"),
        top_features().alias("top_features"),
    )


def run_metrics(scores: DataFrame) -> DataFrame:
    """One row: anomaly count and rate, top score and exact 95th percentile of the scores."""
    head = scores.agg(
        F.count(F.lit(1)).alias("events_scored"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.coalesce(
            F.round(F.count_if("is_anomaly") / F.nullif(F.count(F.lit(1)), F.lit(0)), 4), F.lit(0.0)
        ).alias("anomaly_rate"),
        F.max("anomaly_score").alias("top_score"),
    )
    p95 = value_ranks(scores, "anomaly_score").agg(*quantile_columns("anomaly_score", [0.95], ["score_p95"]))
    # Two one-row results side by side.
    return head.withColumn("score_p95", p95.scalar())
