"""Ranks, exact quantiles and running sums over a column of any size.

Equal values are counted first, so a value that holds most rows is one row afterwards.
The distinct values are then put in order by range, every range is summed on its own, and
the sums of the ranges before it are added.  No step sees the whole column in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertrace.operators.skew import BROADCAST_ROWS, HEAVY_KEYS, join_counts, table_size
from embertrace.session import cut


def cumulative(
    histogram: DataFrame,
    value: str,
    measures: Sequence[str],
    group: Sequence[str] = (),
) -> DataFrame:
    """Running sums of a histogram (one row per group and value) in value order.

    Adds, per measure ``m``: ``m_below`` (sum over smaller values) and ``m_total`` (sum over
    the group), and ``next_value`` (the next larger value, null at the end).  The result is
    computed; reading it again is cheap.
    """
    keys = list(group)
    whole = [F.lit(1)] if not keys else [F.col(k) for k in keys]
    # The range number is written with the rows, so it cannot change on a re-run.
    ranged = cut(histogram.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()))
    per_range = ranged.groupBy(*keys, "_range").agg(
        *[F.sum(m).alias(f"_{m}_here") for m in measures], F.min(value).alias("_first")
    )
    ranges = Window.partitionBy(*whole).orderBy("_range")
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*whole)
    # A row per range and group in it: at most ranges plus groups.
    offsets = per_range.select(
        *keys,
        "_range",
        *[F.coalesce(F.sum(f"_{m}_here").over(before), F.lit(0)).alias(f"_{m}_before") for m in measures],
        *[F.sum(f"_{m}_here").over(everything).alias(f"{m}_total") for m in measures],
        F.lead("_first").over(ranges).alias("_next_first"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value)
    inside_before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # The join and the window below need the same placement by group and range.
    return ranged.join(offsets, [*keys, "_range"]).select(
        *[F.col(c) for c in histogram.columns],
        *[
            (F.col(f"_{m}_before") + F.coalesce(F.sum(m).over(inside_before), F.lit(0))).alias(f"{m}_below")
            for m in measures
        ],
        *[F.col(f"{m}_total") for m in measures],
        F.coalesce(F.lead(value).over(inside), F.col("_next_first")).alias("next_value"),
    )


def value_ranks(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Per distinct value: ``cnt`` rows, ``cnt_below`` smaller ones, ``cnt_total`` in all."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("cnt"))
    return cumulative(counts, value, ["cnt"], group)


def average_percentile(below: Column, count: Column, total: Column) -> Column:
    """Percentile rank where equal values share the average of their ranks."""
    return (below + (count + F.lit(1)) / F.lit(2.0)) / total * F.lit(100.0)


def percentile_rank(
    df: DataFrame,
    value: str,
    spread_by: Column,
    *,
    broadcast_rows: int = BROADCAST_ROWS,
    heavy_keys: int = HEAVY_KEYS,
) -> DataFrame:
    """Add ``percentile``: the average rank of the row's value over all rows, in percent."""
    ranks = cut(
        value_ranks(df, value).select(
            value,
            "cnt",
            average_percentile(F.col("cnt_below"), F.col("cnt"), F.col("cnt_total")).alias("percentile"),
        )
    )
    total = ranks.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first()["n"]
    joined = join_counts(
        df,
        ranks,
        [value],
        "cnt",
        size=table_size(ranks),
        total=total,
        spread_by=spread_by,
        broadcast_rows=broadcast_rows,
        heavy_keys=heavy_keys,
    )
    return joined.select(*df.columns, "percentile")


def quantile_columns(value: str, probabilities: Sequence[float], names: Sequence[str]) -> list[Column]:
    """Aggregates that read exact quantiles off a ``value_ranks`` table.

    A quantile between two rows is interpolated linearly.
    """
    columns = []
    for q, name in zip(probabilities, names):
        at = (F.col("cnt_total") - 1) * F.lit(float(q))
        pick = lambda index: F.max(
            F.when((F.col("cnt_below") <= index) & (index < F.col("cnt_below") + F.col("cnt")), F.col(value))
        )
        lower, upper = pick(F.floor(at)), pick(F.ceil(at))
        part = F.max(at - F.floor(at))
        columns.append((lower + (upper - lower) * part).alias(name))
    return columns


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], group: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles ``q1, q2, …`` per group, without a single-task sort of the column."""
    names = [f"q{i + 1}" for i in range(len(probabilities))]
    return (
        value_ranks(df, value, group).groupBy(*group).agg(*quantile_columns(value, probabilities, names))
    )


def top_rows(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    """The first ``limit`` rows, ordered: a top-k without a full sort.  Without a limit, all rows in no order."""
    return df if limit is None else df.orderBy(*order).limit(limit)

