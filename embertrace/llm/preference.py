"""Preference formatting, in DataFrame functions only.

A pair is a chosen and a rejected conversation.  The longest prefix of turns that both share is
rendered once as the prompt; what follows in each is its completion.  The mask of a completion
lists runs of characters, ``0:n`` not learned and ``1:n`` learned; learned are the contents of
assistant turns with their end marks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from embertrace.llm.staging import staged
from embertrace.operators.skew import join_counts, table_size


@dataclass(frozen=True)
class Template:
    """``head`` takes the role; ``piece_rows`` is how many conversations of one opening a task orders at once."""

    head: str = "<|%s|>\n"
    end: str = "<|end|>\n"
    learned: str = "assistant"
    piece_rows: int = 1 << 14


def conversations_of(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """``name, conv_id, turns array<struct<role, text>>, opening, score`` of every conversation.

    Turns are ordered by number, role and text; repeated turns stay.  A null number comes first, a
    null role counts as ``user``, a null text as empty, and rows with a null id are one
    conversation.  The score is how many characters the assistant wrote.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("all"))
    plain = F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    mine = F.filter("turns", lambda t: t["role"] == template.learned)
    score = F.aggregate(mine, F.lit(0).cast("bigint"), lambda s, t: s + F.length(t["text"]))
    first = F.get("turns", F.lit(0))
    return (
        listed.select("conv_id", plain.alias("turns"))
        .withColumn("name", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
        .withColumn("opening", F.md5(F.concat_ws(":", first["role"], first["text"]).cast("binary")))
        .withColumn("score", score)
    )


def _ranked(items: DataFrame, template: Template) -> DataFrame:
    """``name, opening`` with ``place`` from 0 among the items of an opening, and their number ``n``.

    The order is that of the md5 of the name, which is even, so an opening held by very many
    conversations is ordered in pieces of its range, and these are what is shuffled.
    """
    counted = staged(items.groupBy("opening").agg(F.count("*").alias("n")), "opening-counts")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    digest = F.md5(F.col("name").cast("binary"))
    unit = F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    named = (
        join_counts(items, counted, ["opening"], "n", size=table_size(counted), total=total, spread_by=F.col("name"))
        .withColumn("digest", digest)
        .withColumn("piece", F.floor(unit * F.ceil(F.col("n") / template.piece_rows)))
        .repartition("opening", "piece")
    )
    before = Window.partitionBy("opening").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        named.groupBy("opening", "piece")
        .agg(F.count("*").alias("size"))
        .select("opening", "piece", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("opening", "piece").orderBy("digest", "name")
    return (
        named.withColumn("row", F.row_number().over(inside))
        .join(offsets, ["opening", "piece"])
        .select("name", "opening", "n", (F.col("offset") + F.col("row") - 1).alias("place"))
    )


def sibling_pairs(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``pair_id, chosen, rejected``: conversations of the same first turn two by two.

    Those left over pair up among each other, with nothing in common; a last one without a partner
    has a null ``rejected``.  Chosen is the higher score, then the smaller name.
    """
    names = staged(conversations.select("name", "opening"), "openings")
    placed = staged(_ranked(names, template), "places")
    alone = (F.col("place") == F.col("n") - 1) & (F.col("n") % 2 == 1)
    number = (F.col("place") / 2).cast("bigint")
    rest = _ranked(staged(placed.filter(alone).select("name", F.lit("").alias("opening")), "left-over"), template)
    partner = placed.filter(~alone).unionByName(rest).select("name", F.concat_ws("-", "opening", number).alias("pair_id"))
    side = F.struct((-F.col("score")).alias("rank"), "name", "conv_id", "turns")
    both = (
        conversations.join(partner, "name").groupBy("pair_id").agg(F.sort_array(F.collect_list(side)).alias("sides"))
    )
    return both.select("pair_id", F.get("sides", F.lit(0)).alias("chosen"), F.get("sides", F.lit(1)).alias("rejected"))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns two conversations share from their start."""
    shorter = F.least(F.size(a), F.size(b))
    differ = F.zip_with(F.slice(a, F.lit(1), shorter), F.slice(b, F.lit(1), shorter), lambda x, y: x != y)
    first = F.array_position(differ, True)
    return F.when(first == 0, shorter).otherwise(first - 1).cast("int")


def _rendered(turns: Column, template: Template) -> Column:
    before, after = template.head.split("%s")
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit(template.end))))


def _mask(turns: Column, template: Template) -> Column:
    fixed, end = len(template.head) - 2, len(template.end)
    runs = F.transform(
        turns,
        lambda t: F.concat(
            F.lit("0:"), (F.length(t["role"]) + fixed).cast("string"),
            F.when(t["role"] == template.learned, F.lit(",1:")).otherwise(F.lit(",0:")), (F.length(t["text"]) + end).cast("string"),
        ),
    )
    return F.array_join(runs, ",")


def formatted(pairs: DataFrame, template: Template = Template()) -> DataFrame:
    """Prompt and masked completions of ``pair_id, chosen, rejected`` (structs with ``conv_id, turns``).

    A missing side counts as a conversation without turns.  Equal conversations, or one that is
    the other's beginning, give an empty completion.  An empty table gives an empty table.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.select(
        "pair_id",
        F.col("chosen.conv_id").alias("chosen_id"),
        F.col("rejected.conv_id").alias("rejected_id"),
        F.coalesce("chosen.turns", none).alias("a"),
        F.coalesce("rejected.turns", none).alias("b"),
    ).withColumn("n_common", common_turns(F.col("a"), F.col("b")))
    after = lambda x: F.slice(x, F.col("n_common") + 1, F.greatest(F.size(x) - F.col("n_common"), F.lit(0)))
    return sides.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_common",
        _rendered(F.slice("a", F.lit(1), F.col("n_common")), template).alias("prompt"),
        _rendered(after(F.col("a")), template).alias("chosen"),
        _mask(after(F.col("a")), template).alias("chosen_mask"),
        _rendered(after(F.col("b")), template).alias("rejected"),
        _mask(after(F.col("b")), template).alias("rejected_mask"),
    )


#: The same as SQL over ``conversations``.
PREFERENCE_SQL = """
WITH convs AS (
    SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'null') AS name,
           list({'role': coalesce(role, 'user'), 'text': coalesce(text, '')}
                ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS turns,
           coalesce(sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) END), 0) AS score
    FROM conversations GROUP BY conv_id
), opened AS (
    SELECT *, md5(turns[1].role || ':' || turns[1].text) AS opening FROM convs
), placed AS (
    SELECT *, count(*) OVER (PARTITION BY opening) AS n,
           row_number() OVER (PARTITION BY opening ORDER BY md5(name), name) - 1 AS place
    FROM opened
), first_round AS (
    SELECT name, opening || '-' || (place // 2) AS pair_id FROM placed WHERE NOT (place = n - 1 AND n % 2 = 1)
), second_round AS (
    SELECT name, '-' || ((row_number() OVER (ORDER BY md5(name), name) - 1) // 2) AS pair_id
    FROM placed WHERE place = n - 1 AND n % 2 = 1
), sides AS (
    SELECT pair_id, o.*, row_number() OVER (PARTITION BY pair_id ORDER BY score DESC, name) AS side
    FROM (FROM first_round UNION ALL FROM second_round) p JOIN opened o USING (name)
), pairs AS (
    SELECT c.pair_id, c.conv_id AS chosen_id, r.conv_id AS rejected_id, c.turns AS a, coalesce(r.turns, []) AS b
    FROM sides c LEFT JOIN sides r ON r.pair_id = c.pair_id AND r.side = 2 WHERE c.side = 1
), lengths AS (
    SELECT *, coalesce(list_min([i FOR i IN range(1, least(len(a), len(b)) + 1) IF a[i] <> b[i]]) - 1, least(len(a), len(b))) AS n_common
    FROM pairs
)
SELECT pair_id, chosen_id, rejected_id, CAST(n_common AS INTEGER) AS n_common,
       coalesce(array_to_string(['<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) FOR t IN a[1:n_common]], ''), '') AS prompt,
       coalesce(array_to_string(['<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) FOR t IN a[n_common + 1:]], ''), '') AS chosen,
       coalesce(array_to_string(['0:' || (length(t.role) + 5) || CASE WHEN t.role = 'assistant' THEN ',1:' ELSE ',0:' END
                || (length(t.text) + 8) FOR t IN a[n_common + 1:]], ','), '') AS chosen_mask,
       coalesce(array_to_string(['<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10) FOR t IN b[n_common + 1:]], ''), '') AS rejected,
       coalesce(array_to_string(['0:' || (length(t.role) + 5) || CASE WHEN t.role = 'assistant' THEN ',1:' ELSE ',0:' END
                || (length(t.text) + 8) FOR t IN b[n_common + 1:]], ','), '') AS rejected_mask
FROM lengths
"""
