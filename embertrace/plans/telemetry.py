"""The given tables seen as security telemetry.

``events``, ``documents`` and ``labels`` hold no telemetry of their own; the views below
derive canonical events, scored alerts, triage rows, notifications and executed steps from
them by plain expressions, so every query grows with the given tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embertrace.functions.scoring import score_route
from embertrace.functions.text import lookup
from embertrace.operators.features import command_indicators
from embertrace.operators.triage import confidence_columns
from embertrace.session import cut, even, spread

CATEGORY_OF_TYPE = {
    "signup": "authentication",
    "error": "script_execution",
    "click": "process_creation",
    "view": "network_connection",
    "purchase": "registry_event",
}
CHANNELS = (
    "Microsoft-Windows-Sysmon/Operational",
    "Security",
    "Microsoft-Windows-PowerShell/Operational",
    "Application",
)
ANOMALY_FROM = 0.6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """``events`` (a table or a stream) with the number inside ``props`` and an absolute time."""
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(even(table(spark, sf_dir, "events")))


def _event_columns(text: Column | None = None) -> list[Column]:
    k = F.col("k")
    parent = F.when(k % 12 != 11, F.concat(F.lit("p"), (k % 12).cast("string"), F.lit(".exe")))
    channel = F.try_element_at(F.array(*[F.lit(c) for c in CHANNELS]), k % len(CHANNELS) + 1)
    return [
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("alert_id"),
        "ts",
        F.to_date("ts").alias("event_date"),
        F.struct(F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("name")).alias("host"),
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")).alias("user"),
        F.struct(
            F.concat("event_type", F.lit(".exe")).alias("name"),
            (F.lit(None).cast("string") if text is None else text).alias("command_line"),
            F.struct(parent.alias("name")).alias("parent"),
        ).alias("process"),
        F.struct(
            lookup(F.col("event_type"), CATEGORY_OF_TYPE, "other").alias("category"),
            k.cast("string").alias("id"),
            channel.alias("channel"),
            F.struct(F.when(k % 5 == 0, F.concat(F.lit("T1"), F.lpad(k.cast("string"), 3, "0"))).alias("technique")
                     ).alias("mitre"),
        ).alias("event"),
        F.struct(
            F.struct(
                F.when(k % 3 == 0, F.concat(F.lit("R"), k.cast("string"))).alias("id"),
                F.concat(F.lit("rule for "), "event_type").alias("description"),
                (k % 16).cast("int").alias("level"),
                rule_groups().alias("groups"),
            ).alias("rule")
        ).alias("wazuh"),
        F.col("event_type").alias("source_dataset"),
    ]


def rule_groups() -> Column:
    """Rule groups of a derived alert."""
    k = F.col("k")
    return (
        F.when(k % 4 == 0, F.array(F.lit("Lateral_Movement"), F.lit("logon")))
        .when(k % 4 == 1, F.array(F.lit("execution"), F.lit("sysmon_event1")))
        .when(k % 4 == 2, F.array(F.lit("discovery"), F.lit("Firewall")))
        .otherwise(F.array(F.lit("misc")))
    )


def sec_events_of(base: DataFrame) -> DataFrame:
    """Canonical events without command lines."""
    return base.select(*_event_columns(), "value", "k")


def sec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sec_events_of(base_events(spark, sf_dir))


def _document_of_event(spark: SparkSession, sf_dir: str, documents: DataFrame) -> DataFrame:
    """Events with columns of the document that serves as their command line."""
    n = table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    return (
        base_events(spark, sf_dir)
        .withColumn("doc_id", F.col("event_id") % n)
        .join(documents, "doc_id", "left")
    )


def command_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as command texts; the documents never load anything, so every fortieth gets such a word."""
    loads = F.when(F.col("doc_id") % 40 == 7, F.lit(" DownloadString")).otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", loads).alias("text"))


def sec_events_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with the whole command text."""
    documents = command_texts(spark, sf_dir)
    return _document_of_event(spark, sf_dir, documents).select(*_event_columns(F.col("text")), "value", "k")


def sec_events_with_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical events with the indicators of their command text.

    The text is searched once per document, before one document meets many events, and
    only four numbers per document are moved.
    """
    indicators = command_indicators(F.col("text"))
    documents = spread(command_texts(spark, sf_dir)).select("doc_id", indicators.alias("command_indicators"))
    return _document_of_event(spark, sf_dir, documents).select(
        *_event_columns(), "value", "k", "command_indicators"
    )


def searched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, computed: counting and feature passes read it without joining again."""
    return cut(sec_events_with_indicators(spark, sf_dir))


def scored_of(base: DataFrame) -> DataFrame:
    """Canonical events with an ``ml`` struct; ``value`` stands in for the model's score."""
    score = F.col("value") / (F.col("value") + 50.0)
    flagged = score >= ANOMALY_FROM
    z = lambda i: F.col("k") / 8.0 - F.lit(float(i))
    features = F.array(
        *[
            F.struct(F.lit(name).alias("feature"), z(i).alias("z_score"))
            for i, name in enumerate(("proc_rarity", "parent_child_rarity", "hour"))
        ]
    )
    return sec_events_of(base).withColumn(
        "ml",
        F.struct(
            F.round(score, 6).alias("anomaly_score"),
            F.when(F.col("k") % 9 != 0, F.round(score * 100.0, 2)).alias("anomaly_percentile"),
            flagged.alias("is_anomaly"),
            score_route(F.round(score, 6), flagged).alias("routing_decision"),
            F.when(F.col("k") % 6 != 0, features).alias("top_features"),
        ),
    )


def scored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_of(base_events(spark, sf_dir))


def score_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores table after two runs: an older one that scored everything the other way round, and the newest."""
    rows = scored_alerts(spark, sf_dir)
    stamp = lambda text: F.to_timestamp(F.lit(text)).alias("scored_at")
    older = F.round(F.lit(1.0) - F.col("ml.anomaly_score"), 6)
    first = F.struct(
        older.alias("anomaly_score"),
        F.round(older * 100.0, 2).alias("anomaly_percentile"),
        (older >= ANOMALY_FROM).alias("is_anomaly"),
        score_route(older, older >= ANOMALY_FROM).alias("routing_decision"),
        F.col("ml.top_features").alias("top_features"),
        stamp("2024-03-01 00:00:00"),
    )
    second = F.struct("ml.*", stamp("2024-03-02 00:00:00"))
    run = lambda name, ml: rows.withColumn("ml", ml).withColumn("run_id", F.lit(name))
    return run("20240301_000000", first).unionByName(run("20240302_000000", second))


def label_of(quality: Column, toxic: Column, k: Column) -> Column:
    """False-positive label from a document's labels and the event's number, so that high scores meet each label."""
    return F.when((toxic == 1) | (k % 2 == 1), F.lit("high")).when(quality == 1, F.lit("low")).otherwise(F.lit("medium"))


def triage_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triage rows per labelled event: an early ``medium`` one and the labelled one."""
    labels = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("alert_id"),
        "quality",
        "toxic",
    )
    alerts = scored_alerts(spark, sf_dir).select("alert_id", "ts", "ml", "k")
    rounds = F.array(
        F.struct(F.lit(1).alias("hour"), F.lit("medium").alias("fp_assessment")),
        F.struct(F.lit(2).alias("hour"), label_of(F.col("quality"), F.col("toxic"), F.col("k")).alias("fp_assessment")),
    )
    rows = alerts.join(labels, "alert_id").select("alert_id", "ts", "ml", "k", F.inline(rounds))
    return rows.select(
        "alert_id",
        F.timestamp_micros(F.unix_micros("ts") + F.col("hour") * F.lit(3_600_000_000)).alias("enriched_at"),
        F.when(F.col("k") % 3 == 0, F.lit("A")).otherwise(F.lit("B")).alias("enrichment_path"),
        F.concat(F.lit("T10"), F.lpad((F.col("k") % 60).cast("string"), 2, "0")).alias("attack_technique"),
        "fp_assessment",
        *confidence_columns(
            F.col("ml.anomaly_score"), F.col("ml.anomaly_percentile"), F.col("fp_assessment")
        ),
    )


def notification_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries tried for three in ten events, every second one successful, some of these at the second try."""
    k = F.col("k")
    tries = F.when(k % 10 == 0, F.array(F.lit("failed"), F.lit("sent"))).when(k % 2 == 0, F.array(F.lit("sent")))
    return (
        base_events(spark, sf_dir)
        .filter(F.col("k") % 10 < 3)
        .select(
            F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("alert_id"),
            "ts",
            F.explode(tries.otherwise(F.array(F.lit("failed")))).alias("status"),
        )
    )


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def exec_links_of(base: DataFrame) -> DataFrame:
    """Purchases as steps of an operation, each reported by two polls.

    The step ends ``k`` seconds before the event's time; some stamps are empty or unusable,
    some hosts and techniques are missing.
    """
    k = F.col("k")
    end = iso_text(F.timestamp_micros(F.unix_micros("ts") - k.cast("bigint") * 1_000_000))
    host = F.concat(F.lit("H"), (F.col("user_id") % 20).cast("string"))
    return (
        base.filter(F.col("event_type") == "purchase")
        .select(
            F.concat(F.lit("L"), F.col("event_id").cast("string")).alias("id"),
            (k % 5).cast("int").alias("status"),
            F.when(k % 7 != 0, host).alias("host"),
            F.when(k % 14 != 0, host).alias("paw"),
            F.when(k % 11 == 0, F.lit("")).when(k % 13 == 0, F.lit("not a time")).otherwise(end).alias("finish"),
            F.when(k % 22 != 0, end).alias("create"),
            F.struct(
                F.when(k % 6 != 0, F.concat(F.lit("T1"), F.lpad((k % 40).cast("string"), 3, "0"))).alias(
                    "technique_id"
                ),
                F.when(k % 12 != 0, F.concat(F.lit("ability "), (k % 40).cast("string"))).alias("name"),
            ).alias("ability"),
            F.explode(F.array(F.lit(1), F.lit(2))).alias("poll"),
        )
    )


def exec_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exec_links_of(base_events(spark, sf_dir))
