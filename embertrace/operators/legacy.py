"""The older scoring of log events on two integer-coded text columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace.functions.scoring import min_max_inverted
from embertrace.operators.iforest import Forest, fit_trees
from embertrace.operators.lof import local_outlier_factor
from embertrace.operators.ranking import cumulative
from embertrace.operators.skew import join_counts, table_size
from embertrace.session import cut

CODED = ("event_type", "source_ip")
# Fixed value: trees of the older forest.
LEGACY_TREES = 100


def look_back(rows: DataFrame, as_of: datetime, hours: int = 24, ts: str = "timestamp") -> DataFrame:
    """Rows of the last hours before ``as_of``, both ends included."""
    return rows.filter(F.col(ts).between(F.lit(as_of - timedelta(hours=hours)), F.lit(as_of)))


def value_codes(rows: DataFrame, column: str) -> DataFrame:
    """``column, code, cnt``: position of each distinct value in sorted order, from 0."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))
    numbered = cumulative(counts.withColumn("one", F.lit(1)), column, ["one"])
    return numbered.select(column, F.col("one_below").cast("bigint").alias("code"), "cnt")


def categorical_codes(rows: DataFrame, columns: Sequence[str] = CODED, key: str = "alert_id") -> DataFrame:
    """Add ``<column>_code``: sorted position of the value, -1 for null."""
    coded = rows
    for column in columns:
        codes = cut(value_codes(rows, column))
        total = codes.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first()["n"]
        coded = join_counts(
            coded, codes.select(column, F.col("code").alias(f"{column}_code"), F.col("cnt").alias("_cnt")),
            [column], "_cnt", size=table_size(codes), total=total, spread_by=F.col(key),
        ).drop("_cnt")
        coded = coded.withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(-1)))
    return coded


def legacy_scores(
    rows: DataFrame, method: str = "isolation_forest", *, key: str = "alert_id", seed: int = fv.SEED, k: int = 20
) -> DataFrame:
    """``key, anomaly_score, model`` for every row, by forest or by local outlier factor.

    Rows with equal codes share a score, so the scoring runs on distinct points.
    """
    if method not in ("isolation_forest", "lof"):
        raise ValueError(f"unknown method {method!r}")
    codes = [f"{c}_code" for c in CODED]
    coded = cut(categorical_codes(rows, CODED, key).select(key, *codes))
    stats = coded.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in codes],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in codes],
    ).first()
    n = stats["n"]
    if not n:
        return coded.select(key, F.lit(0.0).alias("anomaly_score"), F.lit(method).alias("model"))
    scales = [stats[f"s_{c}"] or 1.0 for c in codes]
    points = coded.groupBy(*codes).agg(F.count(F.lit(1)).alias("cnt"))
    if method == "lof":
        scored = local_outlier_factor(points, codes, scales, "cnt", k=k).withColumnRenamed("lof", "anomaly_score")
    else:
        axes = [
            ((F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(scale)).alias(f"x{i}")
            for i, (c, scale) in enumerate(zip(codes, scales))
        ]
        slots, size = fit_trees(coded.select(key, *axes), ["x0", "x1"], key, n, trees=LEGACY_TREES, seed=seed)
        raw = cut(Forest.of(slots, ["x0", "x1"], size).score(points.select("*", *axes)))
        bounds = raw.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
        scored = raw.withColumn(
            "anomaly_score", min_max_inverted(F.col("raw"), F.lit(bounds["lo"]), F.lit(bounds["hi"]))
        )
    scored = cut(scored.select(*codes, "cnt", "anomaly_score"))
    return join_counts(
        coded, scored, codes, "cnt", size=table_size(scored), total=n, spread_by=F.col(key)
    ).select(key, "anomaly_score", F.lit(method).alias("model"))
