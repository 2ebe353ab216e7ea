"""Joins against per-key tables that stay balanced when one key holds most rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A table within both bounds is sent to every executor.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
# At most this many keys can each hold 1/HEAVY_KEYS of all rows.
HEAVY_KEYS = 20_000
SALTS = 4096


@dataclass(frozen=True)
class TableSize:
    """Measured size of a computed table."""

    rows: int
    bytes: int

    def may_broadcast(self, rows: int = BROADCAST_ROWS) -> bool:
        return self.rows <= rows and self.bytes <= BROADCAST_BYTES


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: the text as it is, eight for anything else."""
    width = F.lit(8 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            width = width + F.coalesce(F.octet_length(name), F.lit(0))
    return width


def table_size(df: DataFrame) -> TableSize:
    """Measure a computed table."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")).first()
    return TableSize(row["rows"], row["bytes"])


def join_counts(
    left: DataFrame,
    counts: DataFrame,
    on: list[str],
    weight: str,
    *,
    size: TableSize,
    total: int,
    spread_by: Column,
    broadcast_rows: int = BROADCAST_ROWS,
    heavy_keys: int = HEAVY_KEYS,
) -> DataFrame:
    """Left join to a table with unique keys, where ``weight`` is how often a key occurs.

    ``counts`` must be computed already and ``size`` be its measure.  Within the bounds it
    is broadcast.  Beyond them, the keys that each hold at least ``total / heavy_keys``
    rows (no more than ``heavy_keys`` of them) are broadcast, if they fit, and only the
    rows of lighter keys are shuffled by key.  Rows already answered, and rows with a null
    key, travel with a salt so that they spread evenly.
    """
    if size.may_broadcast(broadcast_rows):
        return left.join(F.broadcast(counts), on, "left")

    values = [c for c in counts.columns if c not in on]
    cut_off = max(1, math.ceil(total / heavy_keys))
    heavy = counts.filter(F.col(weight) >= cut_off).select(
        *on, F.lit(True).alias("_heavy"), *[F.col(c).alias(f"_h_{c}") for c in values]
    )
    if table_size(heavy).may_broadcast(heavy_keys):
        heavy = F.broadcast(heavy)
    light = counts.filter(F.col(weight) < cut_off).select(
        *[F.col(c).alias(f"_k_{c}") for c in on],
        F.lit(0).alias("_salt"),
        *[F.col(c).alias(f"_l_{c}") for c in values],
    )
    key_known = F.lit(True)
    for c in on:
        key_known = key_known & F.col(c).isNotNull()
    looked_at = left.join(heavy, on, "left")
    is_open = F.col("_heavy").isNull() & key_known
    keyed = looked_at.select(
        "*",
        *[F.when(is_open, F.col(c)).alias(f"_k_{c}") for c in on],
        F.when(is_open, F.lit(0))
        .otherwise(F.lit(1) + F.pmod(F.xxhash64(spread_by), F.lit(SALTS)).cast("int"))
        .alias("_salt"),
    )
    joined = keyed.join(light, [*[f"_k_{c}" for c in on], "_salt"], "left")
    return joined.select(
        *[F.col(c) for c in left.columns],
        *[F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in values],
    )
