"""Counts by day from which the feature values of any window can be had again.

Eight features do not depend on other events: their values are counted by day.  The five rarities of a window depend
on the window's own counts of keys, so what is counted by day is the keys; summed over the days of a window they give
both the rarity of each key and how many events have it.  Counts add up, so late events of a day are one more batch, and
a drift check reads one row per distinct value and key, never the events.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace.functions.scoring import rarity
from embertrace.operators.features import KINDS, RARITY_KINDS, event_scalars

#: A feature that every event has once: its counts add up to the events of a window.
_EVERY = "hour"


def day_counts(events: DataFrame) -> DataFrame:
    """``day, feature, key1, key2, value, n`` of canonical events: values of plain features, keys of rarities."""
    # the day stands where the scalars carry the id
    rows = event_scalars(events.withColumn("alert_id", F.to_date("ts"))).withColumnRenamed("alert_id", "day")
    nothing = F.lit(None).cast("string")
    parts = []
    for feature in fv.FEATURES:
        keys = [F.col(k) for k in KINDS[RARITY_KINDS[feature]]] if feature in RARITY_KINDS else []
        # a key that lacks a part is none
        usable = F.lit(True)
        for key in keys:
            usable = usable & key.isNotNull()
        first, second = [*[F.when(usable, k) for k in keys], nothing, nothing][:2]
        value = F.lit(None).cast("double") if keys else F.col(feature)
        parts.append(F.struct(F.lit(feature).alias("feature"), first.alias("key1"), second.alias("key2"), value.alias("value")))
    return rows.select("day", F.inline(F.array(*parts))).groupBy("day", "feature", "key1", "key2", "value").agg(F.count(F.lit(1)).alias("n"))


def add_days(events: DataFrame, path: str, batch: int) -> None:
    """Count a batch of events into the table under ``path``; the same batch again replaces what it added."""
    counts = day_counts(events).withColumn("batch", F.lit(batch).cast("bigint"))
    # events without a time belong to no window
    counts = counts.filter(F.col("day").isNotNull()).repartition("day")
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def days(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all batches."""
    return spark.read.schema("feature string, key1 string, key2 string, value double, n bigint, day date, batch bigint").parquet(path)


def window_values(counts: DataFrame, first: date | None = None, after: date | None = None) -> DataFrame:
    """``feature, value, cnt`` over the days from ``first`` up to, not including, ``after``."""
    if first is not None:
        counts = counts.filter(F.col("day") >= F.lit(first))
    if after is not None:
        counts = counts.filter(F.col("day") < F.lit(after))
    summed = counts.groupBy("feature", "key1", "key2", "value").agg(F.sum("n").alias("n"))
    total = counts.filter(F.col("feature") == _EVERY).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    value = F.when(F.col("feature").isin(*RARITY_KINDS), rarity(F.col("n"), F.lit(total), F.col("key1").isNotNull())).otherwise(F.col("value"))
    return summed.select("feature", value.alias("value"), "n").groupBy("feature", "value").agg(F.sum("n").alias("cnt"))


def window_rows(counts: DataFrame, first: date | None = None, after: date | None = None) -> int:
    """The events of a window."""
    values = window_values(counts.filter(F.col("feature") == _EVERY), first, after)
    return values.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]


def drift_histogram(reference: DataFrame, current: DataFrame) -> DataFrame:
    """``feature, value, ref, cur`` of two windows' values, as drift checks read it."""
    none = F.lit(0).cast("bigint")
    both = reference.select("feature", "value", F.col("cnt").alias("ref"), none.alias("cur")).unionByName(
        current.select("feature", "value", none.alias("ref"), F.col("cnt").alias("cur"))
    )
    return both.groupBy("feature", "value").agg(F.sum("ref").alias("ref"), F.sum("cur").alias("cur"))
