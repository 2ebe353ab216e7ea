"""Near-duplicate vectors by int8 tile products with error bounds.

Equal vectors of a label form one class.  The classes of a label are dealt into blocks, and each
pair of blocks is a tile, the work of one task.  In a tile every unit vector ``u`` becomes
``s * q`` with whole numbers ``q`` from -127 to 127; ``e = |u - s q|`` is its quantisation error.
As ``u.v - (s q).(t r) = (u - s q).v + (s q).(v - t r)``, the cosine of two vectors differs from
``s t (q.r)`` by ``e + |s q| f`` at most.  Pairs that the bound puts below the limit are no links,
pairs that it puts above are links, and only the rest are computed in double precision.

A tile returns a row for each class with a link: how many vectors it is linked with there, and the
tile's component it is in.  Links themselves never leave their tile.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embertrace.llm.components import components
from embertrace.llm.staging import staged
from embertrace.operators.skew import TableSize, join_counts
from embertrace.session import ship_package


@dataclass(frozen=True)
class Tiles:
    """``rows`` is the mean size of a block; a tile holds a few matrices of ``rows * rows`` numbers."""

    cosine: float = 0.93
    rows: int = 2048


#: Rounding of the products and norms in double precision.
_SLACK = 1e-9
#: So many products of two numbers up to 127 add up exactly in single precision.
_EXACT = 1024

LINKED = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
_LINKED_DDL = "class bigint, links bigint, root bigint"


class Block:
    """The vectors of a block, their norms and their quantised form."""

    def __init__(self, table: pa.Table):
        self.classes = table["class"].to_numpy()
        self.copies = table["copies"].to_numpy()
        flat = table["vector"].combine_chunks()
        self.vectors = np.asarray(flat.flatten()).reshape(len(table), -1)
        # the largest component becomes 1, so that no square over- or underflows
        self.vectors = self.vectors / np.abs(self.vectors).max(axis=1, keepdims=True)
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        unit = self.vectors / self.norms[:, None]
        self.scales = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scales[:, None]).astype(np.int8)
        back = self.codes * self.scales[:, None]
        self.errors = np.sqrt(((unit - back) ** 2).sum(axis=1))
        self.lengths = np.sqrt((back**2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of int8 rows, exact: single precision holds the sums of ``_EXACT`` components."""
    total = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], _EXACT):
        total += a[:, k : k + _EXACT].astype(np.float32) @ b[:, k : k + _EXACT].astype(np.float32).T
    return total


def links_of(a: Block, b: Block, limit: float, same: bool) -> np.ndarray:
    """Which vector of ``a`` is linked with which of ``b``; ``same``: both are one block, and none is its own link."""
    about = products(a.codes, b.codes)
    about *= a.scales[:, None]
    about *= b.scales[None, :]
    bound = a.errors[:, None] + a.lengths[:, None] * b.errors[None, :] + _SLACK
    linked = about - bound >= limit
    x, y = np.nonzero((about + bound >= limit) & ~linked)
    for k in range(0, len(x), 1 << 16):
        i, j = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
        exact = (a.vectors[i] * b.vectors[j]).sum(axis=1) / (a.norms[i] * b.norms[j])
        linked[i, j] = exact >= limit
    if same:
        linked |= linked.T
        np.fill_diagonal(linked, False)
    return linked


def groups_of(linked: np.ndarray) -> np.ndarray:
    """A number for each row, then for each column, of the component of the links that it is in; -1: no link."""
    n = len(linked)
    group = np.full(sum(linked.shape), -1)
    rows = linked.any(axis=1)
    free = linked.any(axis=0)
    for start in np.flatnonzero(rows):
        if group[start] >= 0:
            continue
        front = np.array([start])
        group[start] = start
        while len(front):
            columns = np.flatnonzero(linked[front].any(axis=0) & free)
            free[columns] = False
            group[n + columns] = start
            front = np.flatnonzero(linked[:, columns].any(axis=1) & (group[:n] < 0)) if len(columns) else columns
            group[front] = start
    return group


def tile(table: pa.Table, limit: float) -> pa.Table:
    """The linked classes of one tile."""
    side = table["side"].to_numpy()
    a = Block(table.filter(pa.array(side == 0)))
    same = not side.any()
    b = a if same else Block(table.filter(pa.array(side == 1)))
    if not len(a.classes) or not len(b.classes):
        return LINKED.empty_table()
    linked = links_of(a, b, limit, same)
    counts, classes = linked @ b.copies, a.classes
    if same:  # a class's row and its column are one
        np.fill_diagonal(linked, linked.any(axis=1))
        group = groups_of(linked)[: len(classes)]
    else:
        group = groups_of(linked)
        counts, classes = np.concatenate([counts, linked.T @ a.copies]), np.concatenate([classes, b.classes])
    of = np.flatnonzero(group >= 0)
    return pa.table([classes[of], counts[of], a.classes[group[of]]], schema=LINKED)


def _classes(vectors: DataFrame) -> DataFrame:
    """``label, vector, first, copies``: the distinct usable vectors of each label."""
    found = vectors.filter("_vector IS NOT NULL").groupBy("_label", "_vector").agg(F.min("_id").alias("first"), F.count("*").alias("copies"))
    return found.withColumn("class", F.monotonically_increasing_id())


def near_vectors(vectors: DataFrame, plan: Tiles = Tiles(), *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The rows with ``n_links``, ``component_id`` and ``kept``, which replace input columns of their names.

    Only rows of equal label and equally long vectors are compared.  Rows without a label, and vectors that
    are null, empty, zero or hold a null or non-finite component, are linked with nothing.  Each row is a vector
    of its own, also where ids repeat: equal vectors are linked with each other.  A component has the smallest
    id among its rows; rows without an id take part, and a component of such rows alone has the id null and is kept.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    numbers = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    fit = (
        F.col(label).isNotNull()
        & (F.size(vector) > 0)
        & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(numbers, lambda x: x != 0)
    )
    rows = vectors.select(F.struct("*").alias("_row"), F.col(key).alias("_id"), F.col(label).alias("_label"), F.when(fit, numbers).alias("_vector"))
    classes = staged(_classes(rows), "vector-classes")

    sized = classes.select(F.col("_label").alias("label"), F.col("_vector").alias("vector"), F.size("_vector").alias("width"), "class", "copies")
    blocks = sized.groupBy("label", "width").agg(F.ceil(F.count("*") / plan.rows).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    placed = sized.join(blocks, ["label", "width"]).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("label", "width", "class", "copies", "vector", "own", other).select(
        "label",
        "width",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "class",
        "copies",
        "vector",
    )
    limit = plan.cosine
    linked = staged(dealt.groupBy("label", "width", "i", "j").applyInArrow(lambda t: tile(t, limit), _LINKED_DDL), "tile-links")

    labels = components(linked.select("class", "root"), "class", "root")
    links = linked.groupBy("class").agg(F.sum("links").alias("links"))
    grouped = classes.join(labels, F.col("class") == F.col("node"), "left").select("class", F.coalesce("label", "class").alias("group"), "first")
    smallest = grouped.groupBy("group").agg(F.min("first").alias("_component"))
    found = staged(
        classes.join(grouped.select("class", "group"), "class")
        .join(smallest, "group")
        .join(links, "class", "left")
        .select("_label", "_vector", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), "_component"),
        "linked-classes",
    )
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_vector") * 8 + 64), F.lit(0)).alias("b"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    known = join_counts(
        rows, found, ["_label", "_vector"], "copies", size=TableSize(size["n"], size["b"]), total=size["rows"], spread_by=F.col("_row")
    )
    in_class = F.col("copies").isNotNull()
    component = F.when(in_class, F.col("_component")).otherwise(F.col("_id"))
    new = {"n_links": F.coalesce("_links", F.lit(0)), "component_id": component, "kept": F.col("_id").eqNullSafe(component)}
    return known.select(*[F.col("_row")[c].alias(c) for c in vectors.columns if c not in new], *[v.alias(c) for c, v in new.items()])
