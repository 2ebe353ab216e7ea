"""A uniform shuffle into shards of exact size, in DataFrame functions only.

Rows lie in blocks by a hash.  How many rows of each block go to each shard is drawn at once as
a communication matrix: a uniform permutation cut into shards of fixed sizes gives each block a
multivariate hypergeometric row, and the draw descends a binary tree over the blocks, in which
every node passes its shard counts on to its two halves.  Then each block permutes its rows and
deals them out by its row of the matrix, the rows are exchanged by shard, and each shard permutes
what it got.  All randomness is hashed from keys, so repeated tasks repeat their draws.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embertrace.llm.staging import staged, text_crc32, unit


@dataclass(frozen=True)
class Deal:
    """``block_rows`` is about how many rows a block, and a piece of a shard, holds."""

    shards: int = 16
    block_rows: int = 1 << 14
    seed: int = 7


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(total: Column, good: Column, taken: Column, u: Column) -> Column:
    """How many of ``taken`` draws out of ``total`` are among the ``good`` ones, by inversion of ``u``.

    Outcomes are gone through from the mode upwards and then from below it downwards, with weights
    relative to the mode, within 9 standard deviations (and 12 more); what lies beyond has less
    weight than the rounding of ``u``.
    """
    low = F.greatest(F.lit(0.0), good + taken - total)
    high = F.least(good, taken)
    mode = F.least(high, F.greatest(low, F.floor((good + 1) * (taken + 1) / (total + 2)).cast("double")))
    some = F.greatest(total, F.lit(1.0))
    variance = taken * good / some * (total - good) / some * (total - taken) / F.greatest(total - 1, F.lit(1.0))
    numbers = F.struct(
        total.cast("double").alias("total"), good.cast("double").alias("good"), taken.cast("double").alias("taken"),
        low.cast("double").alias("low"), high.cast("double").alias("high"), mode.alias("mode"),
        (F.ceil(9 * F.sqrt(variance)) + 12).cast("double").alias("spread"), u.alias("u"),
    )

    def drawn(x: Column) -> Column:
        first, last = F.greatest(x["low"], x["mode"] - x["spread"]), F.least(x["high"], x["mode"] + x["spread"])
        whole = lambda c: c.cast("bigint")
        below = F.when(first < x["mode"], F.sequence(whole(x["mode"]) - 1, whole(first), F.lit(-1).cast("bigint")))
        outcomes = F.concat(
            F.sequence(whole(x["mode"]), whole(last)), F.coalesce(below, F.array().cast("array<bigint>"))
        )
        return _bound(outcomes, lambda ks: inverted(x, ks))

    def weight(x: Column, before: Column, k: Column) -> Column:
        """Weight of outcome k from that of the outcome taken before."""
        odds = lambda k: (x["good"] - k) * (x["taken"] - k) / ((k + 1) * (x["total"] - x["good"] - x["taken"] + k + 1))
        up = F.when(k == x["mode"], F.lit(1.0)).otherwise(before * odds(k - 1))
        return F.when(k >= x["mode"], up).otherwise(F.when(k == x["mode"] - 1, F.lit(1.0)).otherwise(before) / odds(k))

    def inverted(x: Column, ks: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"))
        whole = F.aggregate(
            ks, start, lambda s, k: _bound(weight(x, s["w"], k), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))), lambda s: s["sum"]
        )
        none = F.lit(None).cast("bigint")
        return _bound(
            x["u"] * whole,
            lambda aim: F.aggregate(
                ks,
                F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), none.alias("k")),
                lambda s, k: _bound(
                    weight(x, s["w"], k),
                    lambda w: F.struct(
                        w.alias("w"),
                        (s["sum"] + w).alias("sum"),
                        F.coalesce(s["k"], F.when(s["sum"] + w > aim, k)).alias("k"),
                    ),
                ),
                lambda s: F.coalesce(s["k"], x["mode"].cast("bigint")),
            ),
        )

    return _bound(numbers, drawn)


def communication_matrix(blocks: DataFrame, levels: int, deal: Deal) -> DataFrame:
    """``block, counts array<bigint>``: rows of each block for each shard.

    ``blocks`` is ``block, n`` of all non-empty blocks out of 2**levels.  Shard sizes differ by one at most.
    """
    k = deal.shards
    places = 1 << levels
    every = blocks.sparkSession.range(places).withColumnRenamed("id", "block")
    per = every.join(blocks, "block", "left").agg(
        F.sort_array(F.collect_list(F.struct("block", F.coalesce("n", F.lit(0)).alias("n")))).alias("found"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
    )
    node = per.select(
        F.lit(0).cast("bigint").alias("block"),
        F.transform("found", lambda x: x["n"]).alias("sizes"),
        F.transform(
            F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.floor(F.col("n") / k) + F.when(s < F.col("n") % k, 1).otherwise(0)
        ).alias("counts"),
    )
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda s, x: s + x)
    for level in range(levels):
        half = places >> (level + 1)
        node = node.select(
            "block", "counts", F.slice("sizes", 1, half).alias("left"), F.slice("sizes", half + 1, half).alias("right")
        ).withColumn("taken", add(F.col("left"))).withColumn("total", add(F.col("counts")))
        drawn = F.aggregate(
            F.sequence(F.lit(0), F.lit(k - 1)),
            F.struct(F.col("total").alias("total"), F.col("taken").alias("taken"), F.array().cast("array<bigint>").alias("all")),
            lambda s, j: _next_count(s, j, level, deal),
            lambda s: s["all"],
        )
        node = node.withColumn("mine", drawn).select(
            F.explode(
                F.array(
                    F.struct(F.col("block").alias("block"), F.col("left").alias("sizes"), F.col("mine").alias("counts")),
                    F.struct(
                        (F.col("block") + half).alias("block"),
                        F.col("right").alias("sizes"),
                        F.zip_with("counts", "mine", lambda a, b: a - b).alias("counts"),
                    ),
                )
            ).alias("x")
        ).select("x.*")
    return node.select("block", F.col("counts"))


def _next_count(state: Column, j: Column, level: int, deal: Deal) -> Column:
    own = F.get(F.col("counts"), j)
    drawn = hypergeometric(state["total"], own, state["taken"], unit(F.lit(deal.seed), F.lit(level), F.col("block"), j))
    return F.struct(
        (state["total"] - own).alias("total"), (state["taken"] - drawn).alias("taken"), F.concat(state["all"], F.array(drawn)).alias("all")
    )


def hypergeometric_shards(docs: DataFrame, deal: Deal = Deal(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    Rows are told apart by key and text, nulls included; of rows equal in both, which one gets
    which of their slots does not matter.  An empty table gives an empty table.  Input columns
    named ``shard`` or ``slot`` are replaced.  Shard sizes differ by one row at most.
    """
    docs = docs.drop("shard", "slot")
    named = docs.withColumn("_key", F.xxhash64(F.lit(deal.seed), key, text))
    rows = named.select("_key").count()
    levels = max(0, math.ceil(math.log2(max(1, rows) / deal.block_rows)))
    blocks = F.shiftrightunsigned(F.col("_key"), 64 - levels) if levels else F.lit(0).cast("bigint")
    named = named.withColumn("_block", blocks)
    matrix = staged(communication_matrix(named.groupBy(F.col("_block").alias("block")).agg(F.count("*").alias("n")), levels, deal), "shard-matrix")
    ends = F.transform(
        "counts", lambda c, i: F.aggregate(F.slice(F.col("counts"), F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda s, x: s + x)
    )
    matrix = matrix.select(F.col("block").alias("_block"), ends.alias("_ends"))

    # permuted within its block, a row belongs to the first shard whose end lies beyond it
    local = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(deal.seed + 1), "_key"), "_key")
    dealt = (
        named.withColumn("_at", F.row_number().over(local))
        .join(matrix, "_block")
        .withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_at"))))
        .drop("_ends", "_at", "_block")
    )

    # the second permutation: shards in pieces by the range of a second hash, so that no task sorts a whole shard
    pieces = max(1, math.ceil(rows / deal.shards / deal.block_rows))
    dealt = dealt.withColumn("_order", unit(F.lit(deal.seed + 2), F.col("_key")))
    dealt = dealt.withColumn("_piece", F.floor(F.col("_order") * pieces).cast("bigint"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("shard", "_piece")
        .agg(F.count("*").alias("_n"))
        .select("shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("shard", "_piece").orderBy("_order", "_key")
    return (
        dealt.withColumn("_at", F.row_number().over(inside))
        .join(offsets, ["shard", "_piece"])
        .withColumn("slot", F.col("_before") + F.col("_at") - 1)
        .select(*docs.columns, "shard", "slot")
    )


def shard_plan(docs: DataFrame, deal: Deal = Deal(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key, size, checksum, shard and slot of every row, without its text."""
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        text_crc32(F.col(text)).alias("text_crc32"),
        F.xxhash64(text).alias("text"),
    )
    return hypergeometric_shards(narrow, deal, "text", "doc_id").drop("text")
