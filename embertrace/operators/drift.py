"""Drift, quality and volume checks between two feature windows.

Everything is read off one histogram per feature (value, rows in the reference window, rows
in the current window), so the results are exact and no task sees a whole column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace.operators.ranking import cumulative
from embertrace.session import cut

DRIFT_LIMIT = 0.1
# Floor of the reference deviation in the normalised distance.
STD_FLOOR = 0.001
PSI_BINS = 10
PSI_FLOOR = 1e-4


def _long(features: DataFrame, names: Sequence[str]) -> DataFrame:
    return features.select(*[F.col(f).cast("double").alias(f) for f in names]).unpivot(
        [], list(names), "feature", "value"
    )


def window_histogram(reference: DataFrame, current: DataFrame, names: Sequence[str] = fv.FEATURES) -> DataFrame:
    """``feature, value, ref, cur``: rows with that value in either window."""
    both = _long(reference, names).withColumn("is_ref", F.lit(1)).unionByName(
        _long(current, names).withColumn("is_ref", F.lit(0))
    )
    return (
        both.filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.sum("is_ref").alias("ref"), F.sum(F.lit(1) - F.col("is_ref")).alias("cur"))
    )


def cumulative_windows(histogram: DataFrame) -> DataFrame:
    """The histogram with running sums of both windows, computed once."""
    return cut(cumulative(histogram, "value", ["ref", "cur"], ["feature"]))


def distances(running: DataFrame) -> DataFrame:
    """Per feature: Kolmogorov-Smirnov statistic and Wasserstein-1 distance."""
    ref_share = (F.col("ref_below") + F.col("ref")) / F.nullif(F.col("ref_total"), F.lit(0))
    cur_share = (F.col("cur_below") + F.col("cur")) / F.nullif(F.col("cur_total"), F.lit(0))
    apart = F.abs(ref_share - cur_share)
    width = F.coalesce(F.col("next_value") - F.col("value"), F.lit(0.0))
    return running.groupBy("feature").agg(F.max(apart).alias("ks"), F.sum(apart * width).alias("w1"))


def reference_spread(running: DataFrame) -> DataFrame:
    """Population deviation of the reference window per feature."""
    ref = F.col("ref").cast("double")
    rows = F.nullif(F.sum(ref), F.lit(0.0))
    means = running.groupBy("feature").agg((F.sum(ref * F.col("value")) / rows).alias("mean"))
    # One row per feature.
    return (
        running.join(F.broadcast(means), "feature")
        .groupBy("feature")
        .agg(F.sqrt(F.sum(ref * F.pow(F.col("value") - F.col("mean"), 2)) / rows).alias("ref_std"))
    )


def stability_index(running: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """Population stability index per feature over bins of equal reference share.

    Bin edges are reference values: the smallest whose cumulative share reaches i/bins.
    """
    reached = F.col("ref_below") + F.col("ref")
    edges = running.groupBy("feature").agg(
        F.array(
            *[
                F.min(F.when(reached * bins >= F.col("ref_total") * i, F.col("value")))
                for i in range(1, bins)
            ]
        ).alias("edges")
    )
    # One short row per feature.
    binned = (
        running.join(F.broadcast(edges), "feature")
        .withColumn("bin", sum((F.col("value") > F.col("edges")[i]).cast("int") for i in range(bins - 1)))
        .groupBy("feature", "bin")
        .agg(
            (F.sum("ref") / F.nullif(F.max("ref_total"), F.lit(0))).alias("r"),
            (F.sum("cur") / F.nullif(F.max("cur_total"), F.lit(0))).alias("c"),
        )
        .select("feature", F.greatest("r", F.lit(PSI_FLOOR)).alias("r"), F.greatest("c", F.lit(PSI_FLOOR)).alias("c"))
    )
    return binned.groupBy("feature").agg(F.sum((F.col("c") - F.col("r")) * F.log(F.col("c") / F.col("r"))).alias("psi"))


def drift_table(running: DataFrame, limit: float = DRIFT_LIMIT) -> DataFrame:
    """Per feature: ks, w1, normalised w1, psi, and whether it drifted."""
    # Each side has one row per feature.
    return (
        distances(running)
        .join(F.broadcast(reference_spread(running)), "feature")
        .join(F.broadcast(stability_index(running)), "feature")
        .withColumn("w1_norm", F.col("w1") / F.greatest("ref_std", F.lit(STD_FLOOR)))
        .withColumn("drifted", F.col("w1_norm") >= limit)
    )


def gate_rows(
    drift: DataFrame,
    reference_rows: Column,
    current_rows: Column,
    *,
    max_drifted: int = fv.MAX_DRIFTED_FEATURES,
    min_volume: float = fv.MIN_VOLUME_FRACTION,
) -> DataFrame:
    """One row per check: name, value, limit, passed.  An empty current window fails."""
    checks = drift.agg(F.coalesce(F.count_if("drifted"), F.lit(0)).alias("drifted")).withColumn(
        "rows", current_rows.cast("bigint")
    ).withColumn("floor", F.floor(reference_rows * F.lit(min_volume)).cast("bigint"))
    return checks.select(
        F.inline(
            F.array(
                F.struct(
                    F.lit("drifted_features").alias("name"),
                    F.col("drifted").cast("bigint").alias("value"),
                    F.lit(max_drifted).cast("bigint").alias("limit"),
                    (F.col("drifted") <= max_drifted).alias("passed"),
                ),
                F.struct(
                    F.lit("current_rows").alias("name"),
                    F.col("rows").alias("value"),
                    F.col("floor").alias("limit"),
                    ((F.col("rows") >= F.col("floor")) & (F.col("rows") > 0)).alias("passed"),
                ),
            )
        )
    )


def gate_verdict(gates: DataFrame) -> DataFrame:
    """One row: checks passed, failed, and the overall result."""
    return gates.agg(
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.bool_and("passed").alias("all_passed"),
    )


def quality_profile(features: DataFrame, names: Sequence[str] = fv.FEATURES) -> DataFrame:
    """Per feature: rows, nulls, distinct values, spread, exact quartiles, commonest share."""
    return profile_of(_long(features, names).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt")))


def profile_of(counts: DataFrame) -> DataFrame:
    """The same from ``feature, value, cnt``."""
    counts = cut(counts)
    running = cut(cumulative(counts.filter(F.col("value").isNotNull()), "value", ["cnt"], ["feature"]))
    reached = F.col("cnt_below") + F.col("cnt")
    quartile = lambda q: F.min(
        F.when(reached >= F.col("cnt_total") * F.lit(q), F.col("value"))
    )
    n, value = F.col("cnt").cast("double"), F.col("value")
    shape = running.groupBy("feature").agg(
        F.max("cnt_total").alias("n"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        (F.sum(value * n) / F.sum(n)).alias("mean_value"),
        quartile(0.25).alias("p25"),
        quartile(0.5).alias("p50"),
        quartile(0.75).alias("p75"),
        (F.max("cnt") / F.max("cnt_total")).alias("most_common_share"),
    )
    # One row per feature.
    spread = (
        running.join(F.broadcast(shape.select("feature", "mean_value")), "feature")
        .groupBy("feature")
        .agg(F.sqrt(F.sum(n * F.pow(value - F.col("mean_value"), 2)) / F.sum(n)).alias("std_value"))
    )
    nulls = counts.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("cnt"))), F.lit(0)).alias("nulls")
    )
    return (
        nulls.join(F.broadcast(shape), "feature", "left")
        .join(F.broadcast(spread), "feature", "left")
        .withColumn("is_constant", F.coalesce("distinct_values", F.lit(0)) <= 1)
    )
