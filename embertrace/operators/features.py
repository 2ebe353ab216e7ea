"""Frequency tables and the thirteen numeric features of an event."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace.functions.scoring import rarity
from embertrace.functions.text import folded, has_any, lookup, non_empty, strip
from embertrace.operators.skew import BROADCAST_ROWS, HEAVY_KEYS, TableSize, join_counts, row_bytes
from embertrace.session import cut

# kind of frequency table -> key columns
KINDS = {
    "proc": ("proc",),
    "parent": ("parent",),
    "parent_child": ("parent", "proc"),
    "user": ("user",),
    "host_event": ("host", "cat"),
}
_KEYS = ("proc", "parent", "user", "host", "cat")


def event_keys() -> dict[str, Column]:
    """The key parts of the frequency tables; empty text counts as missing."""
    return {
        "proc": non_empty(F.col("process.name")),
        "parent": non_empty(F.col("process.parent.name")),
        "user": non_empty(F.col("user.name")),
        "host": non_empty(F.col("host.name")),
        "cat": non_empty(F.col("event.category")),
    }


def _group_id(present: tuple[str, ...]) -> int:
    """Value of ``grouping_id()`` for the set that groups by ``present``."""
    return sum(1 << (len(_KEYS) - 1 - i) for i, key in enumerate(_KEYS) if key not in present)


def frequency_tables(events: DataFrame) -> DataFrame:
    """All five frequency tables and the row total in one pass.

    Result: ``kind, key1, key2, n``.  The events are read once; the grouping sets are
    counted on the map side, so a key that holds most rows costs one row per task.
    """
    keyed = events.select(*[expr.alias(name) for name, expr in event_keys().items()])
    grouped = keyed.groupingSets([*[list(keys) for keys in KINDS.values()], []], *_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("gid")
    )
    kind = F.when(F.col("gid") == _group_id(()), F.lit("total"))
    key1 = F.when(F.col("gid") == _group_id(()), F.lit(""))
    key2 = F.lit(None).cast("string")
    for name, keys in KINDS.items():
        here = F.col("gid") == _group_id(keys)
        kind = kind.when(here, F.lit(name))
        key1 = key1.when(here, F.col(keys[0]))
        key2 = F.when(here, F.col(keys[1]) if len(keys) > 1 else F.lit("")).otherwise(key2)
    return (
        grouped.select(kind.alias("kind"), key1.alias("key1"), key2.alias("key2"), "n")
        .filter(F.col("key1").isNotNull() & (F.col("key2").isNotNull() | (F.col("kind") == "total")))
        .withColumn("key2", non_empty(F.col("key2")))
    )


@dataclass(frozen=True)
class Frequencies:
    """Computed frequency tables with the sizes that decide how to join them."""

    table: DataFrame
    sizes: dict[str, TableSize]
    total: int

    @classmethod
    def of(cls, table: DataFrame) -> "Frequencies":
        """Take over a computed ``kind, key1, key2, n`` table."""
        measured = (
            table.groupBy("kind")
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(table)).alias("bytes"), F.sum("n").alias("n"))
            .collect()
        )
        return cls(
            table,
            {r["kind"]: TableSize(r["rows"], r["bytes"]) for r in measured},
            next((r["n"] for r in measured if r["kind"] == "total"), 0),
        )

    @classmethod
    def count(cls, events: DataFrame) -> "Frequencies":
        """Count the events now."""
        return cls.of(cut(frequency_tables(events)))

    def lookup(self, kind: str) -> DataFrame:
        """One frequency table with its own key names and the count ``n_<kind>``."""
        keys = KINDS[kind]
        return self.table.filter(F.col("kind") == kind).select(
            *[F.col(f"key{i + 1}").alias(key) for i, key in enumerate(keys)], F.col("n").alias(f"n_{kind}")
        )


COMMAND_FEATURES = ("has_cmd", "cmd_len", "cmd_has_encoding", "cmd_has_download")


def command_indicators(text: Column) -> Column:
    """Presence, capped length and pattern flags of a command line, as one struct.

    The trimmed and the folded text are bound once each, not once per use.
    """

    def indicators(trimmed: Column) -> Column:
        length = F.length(trimmed)
        words = [w.lower() for w in fv.DOWNLOAD_WORDS]
        download = F.exists(F.array(folded(trimmed)), lambda plain: has_any(plain, words))
        # A blob holds no space, so only words of at least its shortest length are searched.
        blob = F.exists(
            F.split(trimmed, " "),
            lambda word: (F.octet_length(word) >= fv.BASE64_SHORTEST) & F.rlike(word, F.lit(fv.BASE64_BLOB)),
        )
        return F.struct(
            (length > 0).cast("double").alias("has_cmd"),
            F.least(length, F.lit(fv.COMMAND_LENGTH_CAP)).cast("double").alias("cmd_len"),
            blob.cast("double").alias("cmd_has_encoding"),
            download.cast("double").alias("cmd_has_download"),
        )

    return F.get(F.transform(F.array(strip(F.coalesce(text, F.lit("")))), indicators), F.lit(0))


def event_scalars(events: DataFrame) -> DataFrame:
    """Everything that needs no frequency table: key parts and eight features.

    The command text ends here; what follows moves only short columns.  Events may carry
    a struct ``command_indicators`` instead, made where the text is not yet multiplied.
    """
    if "command_indicators" not in events.columns:
        events = events.withColumn("command_indicators", command_indicators(F.col("process.command_line")))
    return events.select(
        "alert_id",
        *[expr.alias(name) for name, expr in event_keys().items()],
        lookup(F.col("event.category"), fv.CATEGORY_RANK, 0).cast("double").alias("event_category_rank"),
        lookup(F.col("event.channel"), fv.CHANNEL_RANK, 0).cast("double").alias("channel_rank"),
        F.coalesce(strip(F.col("event.id")).try_cast("bigint"), F.lit(0)).cast("double").alias("event_id"),
        *[F.coalesce(f"command_indicators.{name}", F.lit(0.0)).alias(name) for name in COMMAND_FEATURES],
        F.coalesce(F.hour("ts"), F.lit(0)).cast("double").alias("hour"),
    )


RARITY_KINDS = {
    "proc_rarity": "proc",
    "parent_proc_rarity": "parent",
    "parent_child_rarity": "parent_child",
    "user_rarity": "user",
    "host_event_rarity": "host_event",
}


def feature_matrix(
    events: DataFrame,
    frequencies: Frequencies | None = None,
    *,
    broadcast_rows: int = BROADCAST_ROWS,
    heavy_keys: int = HEAVY_KEYS,
) -> DataFrame:
    """``alert_id`` and the thirteen features, none null.

    Without ``frequencies`` the events themselves are the corpus.
    """
    corpus = frequencies or Frequencies.count(events)
    rows = event_scalars(events)
    for kind, keys in KINDS.items():
        rows = join_counts(
            rows,
            corpus.lookup(kind),
            list(keys),
            f"n_{kind}",
            size=corpus.sizes.get(kind, TableSize(0, 0)),
            total=corpus.total,
            spread_by=F.col("alert_id"),
            broadcast_rows=broadcast_rows,
            heavy_keys=heavy_keys,
        )
    total = F.lit(corpus.total)
    for name, kind in RARITY_KINDS.items():
        usable = F.lit(True)
        for key in KINDS[kind]:
            usable = usable & F.col(key).isNotNull()
        rows = rows.withColumn(name, rarity(F.col(f"n_{kind}"), total, usable))
    return rows.select("alert_id", *fv.FEATURES)


def rarest_pairs(events: DataFrame, frequencies: Frequencies | None = None, limit: int = 20) -> DataFrame:
    """The parent and child process pairs seen least often, with their rarity."""
    corpus = frequencies or Frequencies.count(events)
    pairs = corpus.lookup("parent_child")
    score = rarity(F.col("n_parent_child"), F.lit(corpus.total), F.lit(True))
    return (
        pairs.select("parent", "proc", F.col("n_parent_child").alias("n"), score.alias("pair_rarity"))
        .orderBy(F.desc("pair_rarity"), "parent", "proc")
        .limit(limit)
    )
