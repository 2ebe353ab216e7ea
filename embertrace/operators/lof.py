"""Local outlier factor on distinct points of a two-dimensional integer grid, with multiplicities.

Breunig, Kriegel, Ng and Sander, "LOF: Identifying Density-Based Local Outliers", SIGMOD 2000.

Neighbours are found exactly, by a quadtree: the plane is halved until no cell holds more than a few points, so
that dense and empty regions alike become leaves of few points.  For each leaf the leaves that can hold neighbours
are found by halving cells and bounding distances; points meet only the points of these.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embertrace.operators.skew import table_size
from embertrace.session import cut

# Keeps densities finite where all neighbours coincide.
EPSILON = 1e-10
# A leaf of the quadtree holds at most so many points, or one more than there are neighbours.
LEAF_POINTS = 16


@dataclass(frozen=True)
class Square:
    """The square that holds all points in units of distance, and how often it may be halved."""

    scales: tuple[float, float]
    x0: int
    y0: int
    side: float
    depth: int

    def cell(self, axis: str, at: int, scale: float) -> Column:
        """Number of the cell of a coordinate at the deepest level; its cell at level l is that without the last bits."""
        return F.floor((F.col(axis) - F.lit(at)) / F.lit(scale * self.side) * F.lit(float(1 << self.depth))).cast("bigint")

    def cells(self, points: DataFrame) -> DataFrame:
        return points.withColumns({"fx": self.cell("x", self.x0, self.scales[0]), "fy": self.cell("y", self.y0, self.scales[1])})

    def side_at(self, level: Column) -> Column:
        return F.lit(self.side) * F.pow(F.lit(0.5), level)


def quadtree(points: DataFrame, square: Square, most: int) -> DataFrame:
    """``level, cx, cy, n, w, leaf``: cells that hold points, halved until none holds more than ``most`` of them.

    ``n`` counts the points of a cell, ``w`` their rows.
    """
    up = lambda c, level: F.call_function("shiftright", F.col(c), (F.lit(square.depth) - level).cast("int"))
    level = F.col("level")
    counted = (
        points.select("fx", "fy", "w", F.explode(F.sequence(F.lit(0), F.lit(square.depth))).alias("level"))
        .groupBy("level", up("fx", level).alias("cx"), up("fy", level).alias("cy"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    )
    counted = cut(counted)
    crowded = counted.filter((F.col("n") > most) & (level < square.depth))
    # a cell is in the tree if the cell around it was halved
    inside = crowded.select((level + 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
    below = (
        counted.withColumns({"px": F.shiftright("cx", 1), "py": F.shiftright("cy", 1)})
        .join(inside, ["level", "px", "py"], "left_semi")
        .drop("px", "py")
    )
    tree = counted.filter(level == 0).unionByName(below)
    return cut(tree.withColumn("leaf", (F.col("n") <= most) | (level == square.depth)))


def _nearest_cells(tree: DataFrame, asking: DataFrame, square: Square, k: int) -> DataFrame:
    """``al, ax, ay, bl, bx, by, bound``: for each asking leaf the leaves that can hold one of the ``k`` nearest rows of a point in it.

    The cell around a leaf holds more than ``k`` rows, so only cells up to its diagonal away matter.  From there the
    cells are halved; in each round the cells that surely hold ``k`` others bound the distance, and those further
    away go.  A leaf beside a dense region thus meets only the region's edge.
    """
    nodes = tree.select(F.col("level").alias("bl"), F.col("cx").alias("bx"), F.col("cy").alias("by"), "n", "w", "leaf")
    size = table_size(nodes)
    lookup = (lambda df: F.broadcast(df)) if size.may_broadcast() else (lambda df: df)
    with_leaves = [r["level"] for r in tree.filter("leaf").select("level").distinct().collect()]
    around = F.greatest(F.col("al") - 1, F.lit(0))
    span = F.sequence(F.lit(-2), F.lit(2))
    near = (
        asking.select("al", "ax", "ay", around.alias("l"), F.shiftright("ax", 1).alias("x0"), F.shiftright("ay", 1).alias("y0"))
        .withColumn("i", F.explode(span))
        .withColumn("j", F.explode(span))
        .select("al", "ax", "ay", "l", (F.col("x0") + F.col("i")).alias("x"), (F.col("y0") + F.col("j")).alias("y"))
        .filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("l"))) & (F.col("y") < F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("l"))))
    )
    # each of these cells is in the tree, or lies in a larger leaf, or holds no points
    levels = F.filter(F.sequence(F.lit(0), F.col("l")), lambda v: (v == F.col("l")) | v.isin(with_leaves))
    step = (F.col("l") - F.col("bl")).cast("int")
    start = near.withColumn("bl", F.explode(levels)).select(
        "al", "ax", "ay", "l", "bl", F.call_function("shiftright", F.col("x"), step).alias("bx"), F.call_function("shiftright", F.col("y"), step).alias("by")
    )
    pairs = start.distinct().join(lookup(nodes), ["bl", "bx", "by"]).filter(F.col("leaf") | (F.col("bl") == F.col("l"))).drop("l").distinct()

    children = nodes.withColumns({"ol": F.col("bl") - 1, "ox": F.shiftright("bx", 1), "oy": F.shiftright("by", 1)})
    leaf = Window.partitionBy("al", "ax", "ay")
    while True:
        a, b = square.side_at(F.col("al")), square.side_at(F.col("bl"))
        gaps, spans = [], []
        for of, to in (("ax", "bx"), ("ay", "by")):
            low_a, high_a, low_b, high_b = F.col(of) * a, (F.col(of) + 1) * a, F.col(to) * b, (F.col(to) + 1) * b
            gaps.append(F.greatest(F.lit(0.0), low_b - high_a, low_a - high_b))
            spans.append(F.greatest(high_b - low_a, high_a - low_b))
        length = lambda xy: F.sqrt(xy[0] * xy[0] + xy[1] * xy[1])
        reach = leaf.orderBy("furthest").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        bounded = (
            pairs.withColumns({"closest": length(gaps), "furthest": length(spans)})
            .withColumn("held", F.sum("w").over(reach))
            # a point's own row is among the held ones
            .withColumn("bound", F.min(F.when(F.col("held") > k, F.col("furthest"))).over(leaf))
            # cell borders are rounded numbers
            .filter(F.col("closest") <= F.col("bound") * (1 + 1e-9) + square.side * 1e-12)
            .drop("closest", "furthest", "held")
        )
        pairs = cut(bounded)
        crowded = pairs.filter(~F.col("leaf"))
        if crowded.isEmpty():
            return pairs.select("al", "ax", "ay", "bl", "bx", "by", "bound")
        halved = crowded.select("al", "ax", "ay", F.col("bl").alias("ol"), F.col("bx").alias("ox"), F.col("by").alias("oy")).join(lookup(children), ["ol", "ox", "oy"])
        columns = ["al", "ax", "ay", "bl", "bx", "by", "n", "w", "leaf"]
        pairs = pairs.filter("leaf").select(*columns).unionByName(halved.select(*columns))


def neighbourhoods(points: DataFrame, square: Square, k: int, most: int | None = None) -> DataFrame:
    """``p, q, qw, d, kdist``: all points no further than the k-th neighbour.

    ``points``: ``p, x, y, w``.  The ``w - 1`` other rows on the same point count as
    neighbours at distance 0 and are listed as a row ``q = p`` when there are any.
    """
    own = points.filter(F.col("w") > 1).select(
        "p", F.col("p").alias("q"), (F.col("w") - 1).alias("qw"), F.lit(0.0).alias("d")
    )
    settled = own.filter(F.col("qw") >= k).withColumn("kdist", F.lit(0.0))
    placed = cut(square.cells(points))
    tree = quadtree(placed, square, most or max(k + 1, LEAF_POINTS))
    # the leaf of a point: the one level of the tree where its cell is a leaf
    leaves = tree.filter("leaf").select("level", "cx", "cy")
    shift = (F.lit(square.depth) - F.col("level")).cast("int")
    levels = F.array(*[F.lit(r["level"]) for r in leaves.select("level").distinct().orderBy("level").collect()])
    homes = placed.withColumn("level", F.explode(levels)).withColumns(
        {"cx": F.call_function("shiftright", F.col("fx"), shift), "cy": F.call_function("shiftright", F.col("fy"), shift)}
    )
    small = table_size(leaves).may_broadcast()
    homes = cut(homes.join(F.broadcast(leaves) if small else leaves, ["level", "cx", "cy"], "left_semi").select("p", "x", "y", "w", "level", "cx", "cy"))
    waiting = homes.filter(F.col("w") <= k)
    asking = waiting.select(F.col("level").alias("al"), F.col("cx").alias("ax"), F.col("cy").alias("ay")).distinct()
    cells = _nearest_cells(tree, asking, square, k)

    of_p = waiting.select("p", F.col("x").alias("px"), F.col("y").alias("py"), F.col("level").alias("al"), F.col("cx").alias("ax"), F.col("cy").alias("ay"))
    of_q = homes.select(F.col("p").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("w").alias("qw"), F.col("level").alias("bl"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    dx, dy = ((F.col(f"p{c}") - F.col(f"q{c}")) / F.lit(scale) for c, scale in zip("xy", square.scales))
    met = (
        cells.join(of_q, ["bl", "bx", "by"])
        .join(of_p, ["al", "ax", "ay"])
        .filter(F.col("p") != F.col("q"))
        .select("p", "q", "qw", F.sqrt(dx * dx + dy * dy).alias("d"), "bound")
        .filter(F.col("d") <= F.col("bound") * (1 + 1e-9))
        .drop("bound")
    )
    # Every neighbour weighs at least one, so k distinct ones with ties are enough.
    nearest = met.withColumn("_r", F.rank().over(Window.partitionBy("p").orderBy("d"))).filter(F.col("_r") <= k).drop("_r")
    running = Window.partitionBy("p").orderBy("d").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        nearest.unionByName(own.join(waiting.select("p"), "p", "left_semi"))
        .withColumn("_sum", F.sum("qw").over(running))
        .withColumn("kdist", F.min(F.when(F.col("_sum") >= k, F.col("d"))).over(Window.partitionBy("p")))
        .filter(F.col("d") <= F.col("kdist"))
        .drop("_sum")
    )
    return settled.unionByName(found)


def local_outlier_factor(
    points: DataFrame, axes: Sequence[str], scales: Sequence[float], weight: str, *, k: int = 20
) -> DataFrame:
    """Add ``lof`` to distinct points.

    ``axes`` are two whole-number columns, each divided by its scale to measure distance;
    ``weight`` is the number of rows on a point.
    """
    ax, ay = axes
    keyed = cut(
        points.withColumn("p", F.struct(ax, ay))
        .withColumn("x", F.col(ax).cast("bigint"))
        .withColumn("y", F.col(ay).cast("bigint"))
        .withColumn("w", F.col(weight).cast("bigint"))
    )
    size = keyed.agg(
        F.sum("w").alias("n"),
        F.count(F.lit(1)).alias("points"),
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        (F.max("x") - F.min("x")).alias("wx"),
        (F.max("y") - F.min("y")).alias("wy"),
    ).first()
    if size["points"] < 2:
        return keyed.drop("p", "x", "y", "w").withColumn("lof", F.lit(1.0))
    neighbours = min(k, size["n"] - 1)
    widths = [size["wx"] / scales[0], size["wy"] / scales[1]]
    gap = min(1.0 / scale for scale, width in zip(scales, widths) if width > 0)
    # a hair more than the widest extent, so that the last point lies inside
    side = max(widths) * (1.0 + 1e-9)
    square = Square((scales[0], scales[1]), size["x0"], size["y0"], side, min(40, max(1, math.ceil(math.log2(side / gap)) + 1)))
    near = cut(neighbourhoods(keyed.select("p", "x", "y", "w"), square, neighbours))

    kdist = near.groupBy("p").agg(F.max("kdist").alias("qk")).withColumnRenamed("p", "q")
    density = cut(
        near.join(kdist, "q")
        .groupBy("p")
        .agg(
            (
                F.lit(1.0)
                / (F.sum(F.greatest("d", "qk") * F.col("qw")) / F.sum("qw") + F.lit(EPSILON))
            ).alias("lrd")
        )
    )
    around = (
        near.join(density.select(F.col("p").alias("q"), F.col("lrd").alias("q_lrd")), "q")
        .groupBy("p")
        .agg((F.sum(F.col("q_lrd") * F.col("qw")) / F.sum("qw")).alias("mean_lrd"))
    )
    factor = around.join(density, "p").select("p", (F.col("mean_lrd") / F.col("lrd")).alias("lof"))
    return keyed.join(factor, "p").drop("p", "x", "y", "w")
