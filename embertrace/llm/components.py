"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.llm.staging import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of a link; the label is the smallest node reachable.

    Each round hangs every node on its smallest neighbour if that is smaller, and renames the
    links by it; a node with no smaller neighbour stays, so at least half of the nodes with
    links go each round.  Labels only fall, and a component's smallest node never moves.
    """
    edges = staged(links.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        ends = F.explode(F.array(F.struct(F.col("a").alias("label"), F.col("b").alias("other")), F.struct(F.col("b").alias("label"), F.col("a").alias("other"))))
        parent = (
            edges.select(ends.alias("e"))
            .groupBy("e.label")
            .agg(F.min("e.other").alias("parent"))
            .filter(F.col("parent") < F.col("label"))
        )
        parent = staged(parent, "parents")
        labels = staged(
            labels.join(parent, "label", "left").select("node", F.coalesce("parent", "label").alias("label")), "labels"
        )
        left = parent.select(F.col("label").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("label").alias("b"), F.col("parent").alias("pb"))
        renamed = edges.join(left, "a", "left").join(right, "b", "left")
        pa, pb = F.coalesce("pa", "a"), F.coalesce("pb", "b")
        edges = staged(
            renamed.filter(pa != pb).select(F.least(pa, pb).alias("a"), F.greatest(pa, pb).alias("b")).distinct(), "links"
        )
    return labels
