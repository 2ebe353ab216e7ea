"""What happened in a time span after each step: a range join that lists no pairs.

A span is covered exactly by time blocks of growing size (powers of ``RADIX``
microseconds).  Events are summed up per host and block beforehand, and a step looks up
its few blocks by equality.  A host or a minute that holds most events costs each step no
more than any other, because the blocks are already summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIX = 8


def block_sizes(span: int) -> list[int]:
    """Block sizes in microseconds for spans of ``span`` microseconds."""
    sizes = [1]
    while sizes[-1] * RADIX <= span + 1:
        sizes.append(sizes[-1] * RADIX)
    return sizes


def event_blocks(at: str, span: int) -> Column:
    """Every block the instant in column ``at`` lies in, as ``array<struct<level, block>>``."""
    parts = [
        f"named_struct('level', {level}, 'block', ({at} - pmod({at}, {size}L)) div {size}L)" if level
        else f"named_struct('level', 0, 'block', {at})"
        for level, size in enumerate(block_sizes(span))
    ]
    return F.expr(f"array({', '.join(parts)})")


def span_blocks(start: str, span: int) -> Column:
    """The fewest blocks that cover ``[start, start + span]`` and nothing else.

    Per size, the whole blocks inside the span are ``first .. after - 1``; what the next
    larger size covers is left to it, so only the two ends remain.
    """
    sizes = block_sizes(span)
    # floor of a quotient of integers, exact for any sign
    floor = lambda x, size: x if size == 1 else f"(({x} - pmod({x}, {size}L)) div {size}L)"
    end = f"({start} + {span + 1}L)"
    first = [floor(f"({start} + {size - 1}L)", size) for size in sizes]
    after = [floor(end, size) for size in sizes]
    listed = []
    for level in range(len(sizes)):
        low, high = first[level], after[level]
        if level + 1 == len(sizes):
            ranges = [(low, high)]
        else:
            covered = f"{first[level + 1]} < {after[level + 1]}"
            ranges = [
                (low, f"if({covered}, {first[level + 1]} * {RADIX}, {high})"),
                (f"if({covered}, {after[level + 1]} * {RADIX}, {high})", high),
            ]
        listed += [
            f"transform(if({a} < {b}, sequence({a}, {b} - 1), array()),"
            f" b -> named_struct('level', {level}, 'block', b))"
            for a, b in ranges
        ]
    return F.expr(f"concat({', '.join(listed)})")


def near_steps(steps: DataFrame, events: DataFrame, span: int, *, step_at: str, event_at: str) -> DataFrame:
    """Events in the span-wide time cells that some step's span touches.

    Steps are few beside events, so most events end here, before they meet the blocks.
    """
    width = F.lit(span + 1)
    cell = lambda ts: F.floor(F.unix_micros(ts) / width)
    touched = steps.select("host", F.explode(F.array(cell(step_at), cell(step_at) + 1)).alias("_cell")).distinct()
    placed = events.withColumn("_cell", cell(event_at))
    return placed.join(touched, ["host", "_cell"], "left_semi").drop("_cell")


def best_in_span(
    steps: DataFrame, events: DataFrame, step_id: str, span_seconds: int, *, step_at: str, event_at: str
) -> DataFrame:
    """Per step: number of events in its span, first instant and best event.

    Both sides carry ``host``; events carry ``score``, ``percentile`` and ``alert_id``.
    Steps without any event are left out.
    """
    span = span_seconds * 1_000_000
    at = F.unix_micros(event_at)
    events = near_steps(steps, events, span, step_at=step_at, event_at=event_at)
    better = F.struct(
        F.col("score").alias("score"), (-at).alias("before"), F.col("alert_id"), F.col("percentile").alias("percentile")
    )
    summed = (
        events.select("host", at.alias("at"), better.alias("best"))
        .select("host", "at", "best", F.inline(event_blocks("at", span)))
        .groupBy("host", "level", "block")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"), F.max("best").alias("best"))
    )
    wanted = steps.select(step_id, "host", F.unix_micros(step_at).alias("at")).select(
        step_id, "host", F.inline(span_blocks("at", span))
    )
    return (
        wanted.join(summed, ["host", "level", "block"])
        .groupBy(step_id)
        .agg(F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("best").alias("best"))
    )


def top_in_span(
    steps: DataFrame, events: DataFrame, step_id: str, span_seconds: int, k: int, *, step_at: str, event_at: str
) -> DataFrame:
    """The ``k`` best events in each step's span, ranked.

    A block keeps its own ``k`` best first, so a crowded block hands over ``k`` rows at most.
    """
    span = span_seconds * 1_000_000
    at = F.unix_micros(event_at)
    events = near_steps(steps, events, span, step_at=step_at, event_at=event_at)
    order = [F.desc("score"), F.col("at"), F.col("alert_id")]
    kept = (
        events.select("host", "score", "percentile", "alert_id", at.alias("at"))
        .select("*", F.inline(event_blocks("at", span)))
        .withColumn("_n", F.row_number().over(Window.partitionBy("host", "level", "block").orderBy(*order)))
        .filter(F.col("_n") <= k)
        .drop("_n")
    )
    wanted = steps.select(step_id, "host", F.unix_micros(step_at).alias("at")).select(
        step_id, "host", F.inline(span_blocks("at", span))
    )
    return (
        wanted.join(kept, ["host", "level", "block"])
        .withColumn("rank", F.row_number().over(Window.partitionBy(step_id).orderBy(*order)))
        .filter(F.col("rank") <= k)
        .select(step_id, "rank", "alert_id", "score", "percentile", F.timestamp_micros("at").alias("detected_at"))
    )
