"""Temperature mixing of sources, realised as block permutations.

With source token shares p, the weights are p**a over their sum.  The exponent a in [0, 1] is
bisected to the target: the largest one at which the weights have an entropy of ``entropy``
bits, or the smallest one at which no source is repeated more than ``max_repeats`` times.  The budget is by default what gives the least repeated source
exactly one pass, so that no document is left out.

Every source is read in passes, each a permutation of its documents; passes follow each other
until the budget of the source is used up.  The stream of each source is cut into ``blocks`` equal
stretches of tokens, block b takes the b-th stretch of each, and is permuted as a whole: every
block has the target weights.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embertrace.llm.staging import split_words, staged, unit


@dataclass(frozen=True)
class Mix:
    """Exactly one of ``entropy`` (bits) and ``max_repeats`` is set; ``budget`` in tokens."""

    max_repeats: float | None = 2.0
    entropy: float | None = None
    budget: float | None = None
    blocks: int = 64
    piece_rows: int = 1 << 12
    seed: int = 5
    steps: int = 40


def tokens_of(text: Column) -> Column:
    """Tokens are words here; a text without any counts as one token."""
    return F.greatest(F.size(split_words(text)), F.lit(1)).cast("bigint")


def _measured(shares: DataFrame, exponents: list[float], mix: Mix) -> list[float]:
    """What the target limits, at each exponent, in one pass over the sources."""
    sums = [F.sum("tokens").alias("t"), F.max("share").alias("most"), F.min("share").alias("least")]
    for k, a in enumerate(exponents):
        power = F.pow("share", F.lit(a))
        sums += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log2("share")).alias(f"l{k}")]
    row = shares.agg(*sums).collect()[0]
    if mix.entropy is not None:
        return [math.log2(row[f"z{k}"]) - a * row[f"l{k}"] / row[f"z{k}"] for k, a in enumerate(exponents)]
    passes = [
        row["most"] ** (1 - a) if mix.budget is None else mix.budget / row["t"] / row[f"z{k}"] for k, a in enumerate(exponents)
    ]
    return [p * row["least"] ** (a - 1) for p, a in zip(passes, exponents)]


def exponent_for(shares: DataFrame, mix: Mix) -> float:
    """The exponent that meets the target; the sources stay distributed, however many there are.

    Both the entropy and the repeats of the smallest source fall as the exponent rises: the
    largest exponent with enough entropy is sought, or the smallest with few enough repeats.  A
    target out of reach gives the end of [0, 1] that comes nearest.  Each pass over the sources
    measures 15 inner points, which is four bisections.
    """
    low, high, ways = 0.0, 1.0, 16
    for _ in range(math.ceil(mix.steps / math.log2(ways))):
        grid = [low + (high - low) * k / ways for k in range(ways + 1)]
        found = _measured(shares, grid, mix)
        above = [k for k, x in enumerate(found) if x >= mix.entropy] if mix.entropy is not None else [k for k, x in enumerate(found) if x > mix.max_repeats]
        if not above:
            return low
        if above[-1] == ways:
            return high
        low, high = grid[above[-1]], grid[above[-1] + 1]
    return low if mix.entropy is not None else high


def source_plan(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source") -> DataFrame:
    """Per source: tokens, share, weight, budget and repeats.  A null source is a source of its own."""
    sums = staged(
        docs.groupBy(F.col(source).alias("source")).agg(F.sum(tokens_of(F.col(text))).alias("tokens"), F.count("*").alias("rows")),
        "mix-sources",
    )
    total = sums.agg(F.sum("tokens").alias("t")).collect()[0]["t"] or 0
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    exponent = exponent_for(shares, mix) if total else 1.0
    powers = shares.withColumn("power", F.pow("share", F.lit(exponent)))
    norm = powers.agg(F.sum("power").alias("z"), F.max(F.col("tokens") / F.col("power")).alias("once")).collect()[0]
    weighed = powers.withColumn("weight", F.col("power") / F.lit(norm["z"] or 1.0))
    budget = mix.budget if mix.budget is not None else (norm["once"] or 0.0) * (norm["z"] or 0.0)
    return weighed.select(
        "source",
        "rows",
        "tokens",
        "share",
        F.lit(exponent).alias("exponent"),
        "weight",
        (F.col("weight") * F.lit(float(budget))).alias("budget"),
        (F.col("weight") * F.lit(float(budget)) / F.col("tokens")).alias("repeats"),
    )


def temperature_mix(docs: DataFrame, mix: Mix = Mix(), text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` as often as they are read, with ``epoch``, ``block`` and ``place``.

    ``place`` is a number in [0, 1): reading a block by it gives its permutation.  A row is read
    in a pass when the tokens of its source before it are fewer than the budget, so a source
    exceeds its budget by less than one document.  Rows are told apart by key and text; rows equal
    in both are each read.  Null texts count one token.  An empty table gives an empty table.
    """
    kept = [c for c in docs.columns if c not in ("epoch", "block", "place")]
    plan = staged(source_plan(docs, mix, text, source), "mix-plan")
    named = docs.select(
        *kept,
        F.xxhash64(F.lit(mix.seed), key, text).alias("_key"),
        tokens_of(F.col(text)).alias("_tokens"),
        F.col(source).alias("_source"),
    )
    rated = plan.select(
        F.col("source").alias("_of"), F.col("tokens").alias("_all"), F.col("budget").alias("_budget"),
        F.greatest(F.lit(1), F.ceil(F.col("rows") / mix.piece_rows)).alias("_pieces"), F.ceil(F.round("repeats", 9)).alias("_passes"),
    )
    narrow = named.select("_key", "_tokens", "_source").groupBy("_key", "_tokens", "_source").agg(F.count("*").alias("_rows"))
    narrow = narrow.join(rated, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    passes = narrow.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_passes") - 1)))
    passes = passes.filter(F.col("_passes") > 0).withColumn("_order", unit(F.lit(mix.seed), F.col("epoch"), F.col("_key")))
    passes = staged(passes.withColumn("_piece", F.floor(F.col("_order") * F.col("_pieces"))), "mix-passes")

    # tokens before a row: whole passes, then whole pieces of its pass, then rows of its piece
    before = Window.partitionBy("_source", "epoch").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        passes.groupBy("_source", "epoch", "_piece")
        .agg(F.sum(F.col("_tokens") * F.col("_rows")).alias("_sum"))
        .select(
            F.col("_source").alias("_s"), F.col("epoch").alias("_e"), F.col("_piece").alias("_p"),
            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        )
    )
    inside = Window.partitionBy("_source", "epoch", "_piece").orderBy("_order", "_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = passes.withColumn("_inside", F.coalesce(F.sum(F.col("_tokens") * F.col("_rows")).over(inside), F.lit(0)))
    same = F.col("_source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("_piece") == F.col("_p"))
    at = F.col("epoch") * F.col("_all") + F.col("_offset") + F.col("_inside")
    read = (
        placed.join(offsets, same)
        .withColumn("_at", at)
        .filter(F.col("_at") < F.col("_budget") * (1 - 1e-12))
        .select(
            "_key", "_tokens", "_source", "epoch",
            F.least(F.lit(mix.blocks - 1), F.floor(F.col("_at") * mix.blocks / F.col("_budget"))).cast("int").alias("block"),
        )
    )
    times = read.groupBy("_key", "_tokens", "_source").agg(F.collect_list(F.struct("epoch", "block")).alias("_times"))
    times = times.withColumnRenamed("_source", "_of").withColumnRenamed("_tokens", "_t")
    match = (F.col("_key") == F.col("_k")) & (F.col("_tokens") == F.col("_t")) & F.col("_source").eqNullSafe(F.col("_of"))
    return (
        named.join(times.withColumnRenamed("_key", "_k"), match)
        .withColumn("_time", F.explode("_times"))
        .select(
            *kept,
            F.col("_time.epoch").cast("int").alias("epoch"),
            F.col("_time.block").alias("block"),
            unit(F.lit(mix.seed + 1), F.col("_time.epoch"), F.col("_key")).alias("place"),
        )
    )
