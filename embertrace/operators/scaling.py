"""Scaler fit, z-scores and what they say about the features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace import fixed_values as fv


def scaler_stats(features: DataFrame) -> DataFrame:
    """Mean and population deviation per feature, one row each, from one aggregation."""
    wide = features.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(f).alias(f"m_{f}") for f in fv.FEATURES],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in fv.FEATURES],
    )
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            F.col("n"),
            F.col(f"m_{f}").alias("mean"),
            F.when(F.col(f"s_{f}") == 0, F.lit(1.0)).otherwise(F.col(f"s_{f}")).alias("std"),
        )
        for f in fv.FEATURES
    ]
    return wide.select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class Scaler:
    """Fitted means and deviations of the thirteen features."""

    n: int
    mean: dict[str, float]
    std: dict[str, float]

    @classmethod
    def fit(cls, features: DataFrame) -> "Scaler":
        return cls.of(scaler_stats(features))

    @classmethod
    def of(cls, stats: DataFrame) -> "Scaler":
        rows = stats.collect()
        return cls(
            rows[0]["n"] if rows else 0,
            {r["feature"]: r["mean"] for r in rows},
            {r["feature"]: r["std"] for r in rows},
        )

    def z(self, feature: str) -> Column:
        return (F.col(feature) - F.lit(self.mean[feature])) / F.lit(self.std[feature])

    def z_scores(self, features: DataFrame) -> DataFrame:
        """The features replaced by their z-scores; other columns stay."""
        return features.select(
            *[c for c in features.columns if c not in fv.FEATURES],
            *[self.z(f).alias(f) for f in fv.FEATURES],
        )


def feature_power(z_scores: DataFrame) -> DataFrame:
    """Mean absolute z-score per feature, strongest first."""
    wide = z_scores.agg(*[F.avg(F.abs(f)).alias(f) for f in fv.FEATURES])
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean_abs_z")) for f in fv.FEATURES]
    return wide.select(F.inline(F.array(*rows))).orderBy(F.desc("mean_abs_z"), "feature")


def top_features(k: int = 3, z: dict[str, Column] | None = None) -> Column:
    """The ``k`` features furthest from the mean, as ``array<struct<feature, z_score>>``.

    On a tie of absolute z-scores the later feature comes first.
    """
    z = z or {f: F.col(f) for f in fv.FEATURES}
    ordered = F.sort_array(
        F.array(
            *[
                F.struct(F.abs(z[f]).alias("size"), F.lit(i).alias("i"), F.lit(f).alias("feature"), z[f].alias("z"))
                for i, f in enumerate(fv.FEATURES)
            ]
        ),
        asc=False,
    )
    return F.transform(
        F.slice(ordered, 1, k),
        lambda x: F.struct(x["feature"].alias("feature"), F.round(x["z"], 3).alias("z_score")),
    )
