"""Isolation forest as Spark jobs: sample, grow one tree per group, score by a walk through tree slots.

Liu, Ting and Zhou, "Isolation Forest", ICDM 2008.

All draws come from md5 of the seed and of what is drawn for, so that the same forest can be grown anywhere,
in SQL too.  Path lengths are multiples of ``1 / PATH_STEPS``: their sums are exact in any order.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from embertrace.session import ship_package

SAMPLE_ROWS = 256
# Expected rows offered to a tree; enough that fewer than SAMPLE_ROWS is very unlikely.
OFFERED_ROWS = 340

PATH_STEPS = 1 << 20
# A prime: draws of rows for trees are taken modulo it.
DRAW_RANGE = (1 << 31) - 1

_TREE_SCHEMA = "tree int, node int, feature int, threshold double, path double"


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def draw(*of: int) -> tuple[int, int]:
    """Two whole numbers below 2**52 that depend on ``of`` only."""
    text = hashlib.md5(":".join(map(str, of)).encode()).hexdigest()
    return int(text[:13], 16), int(text[13:26], 16)


def tree_factors(trees: int, seed: int) -> list[int]:
    """What a row's number is multiplied with to be drawn for each tree."""
    return [1 + draw(seed, tree)[0] % (DRAW_RANGE - 1) for tree in range(trees)]


def grow_tree(rows: np.ndarray, seed: int, tree: int, height: int) -> pd.DataFrame:
    """One isolation tree over at most ``SAMPLE_ROWS`` rows, stored by heap position.

    Every slot of the full binary layout is filled: below a leaf both children repeat the
    leaf, so a walk of exactly ``height`` steps always ends on the right path length.
    """
    slots = 2 ** (height + 1) - 1
    feature = np.zeros(slots, dtype=np.int32)
    threshold = np.full(slots, np.inf)
    path = np.zeros(slots)
    pending: list[tuple[int, int, np.ndarray | None, float]] = [(0, 0, rows, 0.0)]
    while pending:
        slot, depth, here, settled = pending.pop()
        path[slot] = settled
        splittable = np.array([], dtype=int)
        if here is not None:
            lo, hi = here.min(axis=0), here.max(axis=0)
            splittable = np.flatnonzero(hi > lo)
            if depth == height or len(here) <= 1 or len(splittable) == 0:
                settled, here = round((depth + average_path(len(here))) * PATH_STEPS) / PATH_STEPS, None
                path[slot] = settled
        if depth == height:
            continue
        left, right = 2 * slot + 1, 2 * slot + 2
        if here is None:
            pending += [(left, depth + 1, None, settled), (right, depth + 1, None, settled)]
            continue
        which, where = draw(seed, tree, slot)
        f = int(splittable[which % len(splittable)])
        at = lo[f] + where / (1 << 52) * (hi[f] - lo[f])
        if at >= hi[f]:
            at = lo[f]
        feature[slot], threshold[slot] = f, at
        goes_left = here[:, f] <= at
        pending += [(left, depth + 1, here[goes_left], 0.0), (right, depth + 1, here[~goes_left], 0.0)]
    return pd.DataFrame(
        {"tree": np.int32(tree), "node": np.arange(slots, dtype=np.int32), "feature": feature,
         "threshold": threshold, "path": path}
    )


def sample_for_trees(rows: DataFrame, key: str, n: int, trees: int, seed: int) -> tuple[DataFrame, int]:
    """Rows with a ``tree`` number, exactly ``min(SAMPLE_ROWS, n)`` per tree.

    Chosen by md5 of key and seed, so the sample does not depend on partitioning.  One md5 per input row keeps a
    pool of bounded size; only the pool is offered to every tree, by ``(a * factor + b) mod DRAW_RANGE`` with two
    numbers ``a, b`` of the row.
    """
    size = min(SAMPLE_ROWS, n)
    text = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    number = lambda first: F.conv(F.substring("_md5", first, 7), 16, 10).cast("bigint")
    pool_target = trees * OFFERED_ROWS
    pool, pool_rows = rows.withColumn("_md5", text), n
    if n > pool_target:
        pool = pool.filter(number(15) < int(pool_target / n * (1 << 28)))
        pool_rows = pool_target
    factors = F.array(*[F.struct(F.lit(t).alias("tree"), F.lit(f).cast("bigint").alias("_factor")) for t, f in enumerate(tree_factors(trees, seed))])
    offered = (
        pool.withColumns({"_a": number(1), "_b": number(8)})
        .select(*rows.columns, "_a", "_b", F.inline(factors))
        .withColumn("_draw", (F.col("_a") * F.col("_factor") + F.col("_b")) % DRAW_RANGE)
    )
    if pool_rows > OFFERED_ROWS:
        offered = offered.filter(F.col("_draw") < int(OFFERED_ROWS / pool_rows * DRAW_RANGE))
    order = Window.partitionBy("tree").orderBy("_draw", key)
    return offered.withColumn("_pick", F.row_number().over(order)).filter(F.col("_pick") <= size), size


def fit_trees(
    rows: DataFrame, columns: Sequence[str], key: str, n: int, *, trees: int, seed: int
) -> tuple[DataFrame, int]:
    """Grow the forest: a table of tree slots, and the sample size per tree."""
    sample, size = sample_for_trees(rows, key, n, trees, seed)
    height = max(1, math.ceil(math.log2(max(size, 2))))
    names = list(columns)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("_pick")
        return grow_tree(ordered[names].to_numpy(dtype=float), seed, int(ordered["tree"].iloc[0]), height)

    ship_package(rows.sparkSession)
    grown = sample.select("tree", "_pick", *names).groupBy("tree").applyInPandas(grow, _TREE_SCHEMA)
    return grown, size


@dataclass(frozen=True)
class Forest:
    """Slot arrays of a fitted forest: a few megabytes whatever the size of the data."""

    columns: tuple[str, ...]
    sample_size: int
    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray

    @classmethod
    def of(cls, slots: DataFrame, columns: Sequence[str], sample_size: int) -> "Forest":
        """Read the bounded table of tree slots."""
        table = slots.toPandas().sort_values(["tree", "node"])
        trees = table["tree"].nunique()
        shape = (trees, len(table) // max(trees, 1))
        return cls(
            tuple(columns),
            sample_size,
            table["feature"].to_numpy(np.int32).reshape(shape),
            table["threshold"].to_numpy(float).reshape(shape),
            table["path"].to_numpy(float).reshape(shape),
        )

    def slots(self, spark: SparkSession) -> DataFrame:
        """The forest as a table, to be written."""
        trees, slots = self.feature.shape
        frame = pd.DataFrame(
            {
                "tree": np.repeat(np.arange(trees, dtype=np.int32), slots),
                "node": np.tile(np.arange(slots, dtype=np.int32), trees),
                "feature": self.feature.ravel(),
                "threshold": self.threshold.ravel(),
                "path": self.path.ravel(),
            }
        )
        return spark.createDataFrame(frame, _TREE_SCHEMA)

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        """Raw score per row, in [-1, 0); lower is more anomalous."""
        n, slots = len(x), self.feature.shape[1]
        height = int(math.log2(slots + 1)) - 1
        flat = np.ascontiguousarray(x).ravel()
        base = np.arange(n) * x.shape[1]
        total = np.zeros(n)
        for feature, threshold, path in zip(self.feature, self.threshold, self.path):
            at = np.zeros(n, dtype=np.int64)
            for _ in range(height):
                at = 2 * at + 1 + (flat[base + feature[at]] > threshold[at])
            total += path[at]
        scale = len(self.path) * max(average_path(self.sample_size), 1e-12)
        return -np.exp2(-total / scale)

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``raw`` to rows that carry the forest's columns (already scaled)."""
        ship_package(rows.sparkSession)
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def walk(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            forest = shared.value
            for columns in parts:
                yield pd.Series(forest.raw_scores(np.column_stack([c.to_numpy(float) for c in columns])))

        return rows.withColumn("raw", walk(*[F.col(c) for c in self.columns]))

    def walk(self, rows: DataFrame) -> DataFrame:
        """The same as ``score`` in column expressions: no Python worker takes part.

        A row holds its place among the slots of the level in one column per tree, and a step moves all of them down
        a level.  Outside of lambdas these are compiled; a literal holds the slots of one tree and one level.
        """
        trees, slots = self.feature.shape
        height = int(math.log2(slots + 1)) - 1
        array = lambda values, kind: F.from_json(F.lit(json.dumps(values.tolist())), f"array<{kind}>")
        # below a leaf any way is as good: both children repeat it
        threshold = np.where(np.isinf(self.threshold), 1e300, self.threshold)
        at = lambda tree: F.col(f"_at{tree}")

        def down(tree: int, level: slice) -> Column:
            x = F.get(F.col("_x"), F.get(array(self.feature[tree, level], "int"), at(tree)))
            return at(tree) * 2 + (x > F.get(array(threshold[tree, level], "double"), at(tree))).cast("int")

        x = F.array(*[F.col(c).cast("double") for c in self.columns])
        walked = rows.select("*", x.alias("_x"), *[F.lit(0).alias(f"_at{tree}") for tree in range(trees)])
        for depth in range(height):
            level = slice((1 << depth) - 1, (2 << depth) - 1)
            walked = walked.select(*rows.columns, "_x", *[down(tree, level).alias(f"_at{tree}") for tree in range(trees)])
        ends = [F.get(array(self.path[tree, (1 << height) - 1 :], "double"), at(tree)) for tree in range(trees)]
        scale = trees * max(average_path(self.sample_size), 1e-12)
        return walked.select(*rows.columns, (-F.pow(F.lit(2.0), -reduce(add, ends, F.lit(0.0)) / F.lit(scale))).alias("raw"))


def one_row(spark: SparkSession, schema: str, **values) -> DataFrame:
    """A table of one row."""
    return spark.createDataFrame([Row(**values)], schema)
