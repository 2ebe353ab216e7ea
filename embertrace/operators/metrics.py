"""Report aggregates over events and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts_with_total(rows: DataFrame, key: str, count_name: str = "events") -> DataFrame:
    """Rows per value and in all.  ``is_total`` marks the row of all, since a null key is a value too."""
    return rows.rollup(key).agg((F.grouping(key) == 1).alias("is_total"), F.count(F.lit(1)).alias(count_name))


def counts(rows: DataFrame, *keys: Column) -> DataFrame:
    """Rows per key."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))


def anomaly_rate(scores: DataFrame, ts: Column, is_anomaly: Column, width: str = "1 day") -> DataFrame:
    """Events, anomalies and their share per time window."""
    return (
        scores.groupBy(F.window(ts, width).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(is_anomaly).alias("anomalies"))
        .select(
            F.col("w.start").alias("window_start"),
            "events",
            "anomalies",
            F.round(F.col("anomalies") / F.col("events"), 6).alias("anomaly_rate"),
        )
    )


def score_histogram(rows: DataFrame, value: Column, lo: float, hi: float, bins: int = 50) -> DataFrame:
    """Rows per equal-width bin; the upper end belongs to the last bin.

    Values below and above the range are counted in bins 0 and ``bins + 1``, missing ones in
    a null bin.
    """
    bin_no = F.when(value == hi, F.lit(bins).cast("bigint")).otherwise(
        F.width_bucket(value, F.lit(lo), F.lit(hi), F.lit(bins))
    )
    return rows.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def top_mean(rows: DataFrame, key: str, value: str, above: float, limit: int = 20) -> DataFrame:
    """Keys with the highest mean of the values above a bound."""
    return (
        rows.filter(F.col(value) > above)
        .groupBy(key)
        .agg(F.avg(value).alias("mean_score"))
        .orderBy(F.desc("mean_score"), key)
        .limit(limit)
    )


def cursor(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """The newest time of a batch, where the next one starts, and its rows."""
    return rows.agg(F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("events"))
