"""Every operator as a query over the given tables: ``name -> (spark, sf_dir) -> DataFrame``.

Times leave as text and nested values as flat columns, so that results compare by value.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace import schemas
from embertrace.functions import prompts
from embertrace.functions.scoring import min_max_inverted, score_route, to_number
from embertrace.functions.text import base_name, event_category, group_category, group_tactic, lookup
from embertrace.operators import alerts, coverage, day_state, drift, features, ledger, legacy, metrics, normalise, ranking, triage
from embertrace.operators.iforest import Forest, average_path, fit_trees
from embertrace.operators.model import run_metrics
from embertrace.operators.scaling import Scaler, feature_power, scaler_stats, top_features
from embertrace.plans import legacy_job as legacy_job_plan
from embertrace.plans import retrain as retrain_plan
from embertrace.plans import telemetry as t
from embertrace.session import cut, scratch_path, setting, spread
from embertrace.sources import archives, manifest, scans, tables
from embertrace.sources.alert_state import AlertState
from embertrace.streaming.bridge import alert_events, bridge_stream, run_available, text_stream
from embertrace.streaming.monitor import monitored_steps, stateful
from embertrace.streaming.notifier import notification_log, notify_batch, notify_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's own name."""

    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return function(spark, sf_dir)

    QUERIES[function.__name__] = prepared
    return function


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def ts_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(value: Column | str) -> Column:
    return F.round(value, 6)


# --- features -----------------------------------------------------------------------


@query
def pair_rarity_topk(spark, sf_dir):
    rows = features.rarest_pairs(t.sec_events(spark, sf_dir))
    return rows.withColumn("pair_rarity", r6("pair_rarity"))


@query
def freq_tables(spark, sf_dir):
    return features.frequency_tables(t.sec_events(spark, sf_dir))


@query
def feature_matrix(spark, sf_dir):
    rows = features.feature_matrix(t.searched_events(spark, sf_dir))
    return rows.select("alert_id", *[r6(f).alias(f) for f in fv.FEATURES])


@query
def category_rank(spark, sf_dir):
    category = F.col("event.category")
    return (
        t.sec_events(spark, sf_dir)
        .groupBy(category.alias("category"))
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("category_rank", lookup(F.col("category"), fv.CATEGORY_RANK, 0))
    )


@query
def channel_rank(spark, sf_dir):
    return (
        t.sec_events(spark, sf_dir)
        .groupBy(F.col("event.channel").alias("channel"))
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("channel_rank", lookup(F.col("channel"), fv.CHANNEL_RANK, 0))
    )


@query
def windows_categories(spark, sf_dir):
    """Category by channel and event id, over all combinations the events give."""
    code = (
        F.when(F.col("event.channel") == "Security", 4600 + F.col("k") * 2 + F.col("value").cast("int") % 2)
        .otherwise(F.col("k"))
        .cast("bigint")
    )
    channel = F.col("event.channel")
    return (
        t.sec_events(spark, sf_dir)
        .groupBy(channel.alias("channel"), code.alias("code"))
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("category", event_category(F.col("channel"), F.col("code")))
    )


@query
def cmd_indicators(spark, sf_dir):
    documents = spread(t.command_texts(spark, sf_dir))
    return documents.select("doc_id", features.command_indicators(F.col("text")).alias("c")).select("doc_id", "c.*")


# --- scaling and ranking ------------------------------------------------------------


def _features(spark, sf_dir) -> DataFrame:
    """Features of all events, computed once."""
    return cut(features.feature_matrix(t.searched_events(spark, sf_dir)))


def _z(spark, sf_dir) -> DataFrame:
    rows = _features(spark, sf_dir)
    return Scaler.fit(rows).z_scores(rows)


@query
def scaler_stats_table(spark, sf_dir):
    return scaler_stats(_features(spark, sf_dir)).select("feature", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query
def zscores(spark, sf_dir):
    return _z(spark, sf_dir).select("alert_id", *[r6(f).alias(f) for f in fv.FEATURES])


@query
def feature_power_table(spark, sf_dir):
    return feature_power(_z(spark, sf_dir)).select("feature", r6("mean_abs_z").alias("mean_abs_z"))


@query
def top3_features(spark, sf_dir):
    rows = _z(spark, sf_dir).select("alert_id", F.posexplode(top_features()).alias("pos", "f"))
    return rows.select(
        "alert_id", (F.col("pos") + 1).alias("place"), F.col("f.feature").alias("feature"),
        F.col("f.z_score").alias("z_score"),
    )


@query
def minmax_score(spark, sf_dir):
    events = t.table(spark, sf_dir, "events")
    raw = -F.col("value")
    lo, hi = events.select(F.min(raw)).scalar(), events.select(F.max(raw)).scalar()
    return events.select("event_id", r6(min_max_inverted(raw, lo, hi)).alias("score"))


@query
def percentile_rank_avg(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select("event_id", "value")
    ranked = ranking.percentile_rank(rows, "value", F.col("event_id"))
    return ranked.select("event_id", r6("percentile").alias("percentile"))


@query
def value_quantiles(spark, sf_dir):
    rows = t.table(spark, sf_dir, "events").select("event_type", "value")
    q = ranking.exact_quantiles(rows, "value", [0.05, 0.25, 0.5, 0.75, 0.95], ["event_type"])
    return q.select("event_type", *[r6(f"q{i}").alias(f"q{i}") for i in range(1, 6)])


@query
def score_routing(spark, sf_dir):
    """Raw score -> cut-off at the contamination quantile -> flag and route."""
    raw = t.table(spark, sf_dir, "events").select("event_id", (-F.col("value")).alias("raw"))
    ranks = cut(ranking.value_ranks(raw, "raw"))
    row = ranks.agg(
        *ranking.quantile_columns("raw", [fv.CONTAMINATION], ["cut_off"]),
        F.min("raw").alias("lo"),
        F.max("raw").alias("hi"),
    ).first()
    score = min_max_inverted(F.col("raw"), F.lit(row["lo"]), F.lit(row["hi"]))
    flagged = F.col("raw") < F.lit(row["cut_off"])
    return raw.select(
        "event_id", r6(score).alias("score"), flagged.alias("is_anomaly"), score_route(score, flagged).alias("route")
    )


# --- alerts and triage --------------------------------------------------------------


@query
def combined_confidence(spark, sf_dir):
    return t.triage_rows(spark, sf_dir).select(
        "alert_id", ts_text(F.col("enriched_at")).alias("enriched_at"), "fp_assessment", "combined_confidence",
        "llm_confidence", "if_llm_disagreement", "routing_decision",
    )


@query
def fused_routing(spark, sf_dir):
    return metrics.counts(t.triage_rows(spark, sf_dir), F.col("routing_decision"), F.col("fp_assessment"))


def _current(spark, sf_dir) -> DataFrame:
    return alerts.current_alerts(
        t.score_runs(spark, sf_dir), t.triage_rows(spark, sf_dir), t.notification_rows(spark, sf_dir)
    )


_STATES: dict[tuple[str, str], AlertState] = {}


def _state(spark, sf_dir) -> DataFrame:
    """The maintained state, made once in a session and read by every question about alerts."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STATES:
        made = AlertState(spark, scratch_path(spark, "alert-state"), buckets=8)
        made.refresh(t.score_runs(spark, sf_dir), t.triage_rows(spark, sf_dir), t.notification_rows(spark, sf_dir))
        _STATES[key] = made
    return _STATES[key].read()


def prepare(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], object]]:
    """What is maintained beside the tables, and made once before questions are asked: by name, how to make it."""
    return {"alert_state": lambda: _state(spark, sf_dir), "stored_run": lambda: _stored_run(spark, sf_dir)}


def _flat_state(rows: DataFrame) -> DataFrame:
    return rows.select(
        "alert_id",
        F.col("ml.anomaly_score").alias("anomaly_score"),
        "enriched",
        "notified",
        "score_routing",
        "fused_routing",
        ts_text(F.col("triage.enriched_at")).alias("enriched_at"),
        F.col("triage.fp_assessment").alias("fp_assessment"),
        ts_text(F.col("notified_at")).alias("notified_at"),
    )


@query
def current_alerts(spark, sf_dir):
    return _flat_state(_current(spark, sf_dir))


@query
def alert_state_delta(spark, sf_dir):
    """The state after three deltas, the last of them twice: first scores, first triage, then all that is newer."""
    scores, triaged = t.score_runs(spark, sf_dir), t.triage_rows(spark, sf_dir)
    state = AlertState(spark, scratch_path(spark, "alert-state"), buckets=8)
    early = F.col("fp_assessment") == "medium"
    state.apply(scores.filter(F.col("run_id") < "20240302"), triaged.filter(early))
    state.apply(triage=triaged.filter(~early), notifications=t.notification_rows(spark, sf_dir))
    for _ in range(2):
        state.refresh(scores, triaged, t.notification_rows(spark, sf_dir))
    return _flat_state(state.read())


@query
def alert_queue(spark, sf_dir):
    return alerts.alert_queue(_state(spark, sf_dir))


@query
def disagreement(spark, sf_dir):
    return alerts.disagreement_queue(alerts.alert_queue(_state(spark, sf_dir), 0.0, None))


@query
def anomaly_top10(spark, sf_dir):
    return alerts.anomaly_top(_state(spark, sf_dir))


@query
def score_preview(spark, sf_dir):
    return alerts.score_preview(t.scored_alerts(spark, sf_dir))


@query
def unenriched_topn(spark, sf_dir):
    rows = triage.unenriched(t.scored_alerts(spark, sf_dir), t.triage_rows(spark, sf_dir), 50)
    return rows.select("alert_id", F.col("ml.anomaly_score").alias("anomaly_score"))


@query
def pending_notify(spark, sf_dir):
    rows = alerts.pending_notifications(_state(spark, sf_dir))
    return rows.select("alert_id", F.col("triage.combined_confidence").alias("combined_confidence"), "fused_routing")


@query
def notify_payload(spark, sf_dir):
    rows = alerts.payload(alerts.pending_notifications(_state(spark, sf_dir), None), "scores")
    inside = lambda path: F.get_json_object("payload", path)
    return rows.select(
        "alert_id",
        "routing_decision",
        "combined_confidence",
        "anomaly_score",
        "enrichment_path",
        ts_text(F.col("timestamp")).alias("timestamp"),
        "host",
        inside("$.es_index").alias("es_index"),
        inside("$.alert.process.name").alias("alert_process"),
    )


@query
def log_triage_top10(spark, sf_dir):
    logs = normalise.log_lines(_log_lines(spark, sf_dir), F.lit(at("2024-02-01")))
    rows = alerts.log_triage_input(logs)
    return rows.withColumn("timestamp", ts_text(F.col("timestamp")))


@query
def kpi_row(spark, sf_dir):
    row = alerts.key_figures(_state(spark, sf_dir))
    return row.select(
        "total_events", "anomalies", "enriched", "min_score", "max_score",
        *[r6(c).alias(c) for c in ("avg_score", "anomaly_pct", "enriched_pct")],
        F.round("sum_score", 4).alias("sum_score"),
    )


@query
def run_metric_rows(spark, sf_dir):
    scores = t.scored_alerts(spark, sf_dir).select("alert_id", "ml.anomaly_score", "ml.is_anomaly")
    wide = run_metrics(scores)
    figures = wide.select(*[r6(F.col(c).cast("double")).alias(c) for c in wide.columns])
    rows = ledger.metric_rows(F.lit("run-1"), "metric", figures)
    return rows.withColumn("value", F.col("value").cast("double"))


@query
def anomaly_rate_daily(spark, sf_dir):
    rows = metrics.anomaly_rate(t.scored_alerts(spark, sf_dir), F.col("ts"), F.col("ml.is_anomaly"))
    return rows.withColumn("window_start", ts_text(F.col("window_start")))


@query
def score_hist50(spark, sf_dir):
    return metrics.score_histogram(t.scored_alerts(spark, sf_dir), F.col("ml.anomaly_score"), 0.0, 1.0)


@query
def mean_score_top20(spark, sf_dir):
    rows = t.scored_alerts(spark, sf_dir).select(F.col("user.name").alias("source_ip"), "ml.anomaly_score")
    return metrics.top_mean(rows, "source_ip", "anomaly_score", 0.75).withColumn("mean_score", r6("mean_score"))


@query
def source_counts_total(spark, sf_dir):
    return metrics.counts_with_total(t.table(spark, sf_dir, "documents"), "source")


@query
def parent_counts_total(spark, sf_dir):
    """Parents and all events; events without a parent count in both."""
    parents = t.sec_events(spark, sf_dir).select(F.col("process.parent.name").alias("parent"))
    return metrics.counts_with_total(parents, "parent")


@query
def category_counts(spark, sf_dir):
    events = t.sec_events(spark, sf_dir)
    return metrics.counts(events, F.col("event.category").alias("category"), "source_dataset")


@query
def triage_summary(spark, sf_dir):
    """Every anomaly was tried; those with usable labels succeeded."""
    scores = t.scored_alerts(spark, sf_dir)
    newest = alerts.latest(t.triage_rows(spark, sf_dir), "alert_id", "enriched_at")
    return triage.triage_summary(scores.filter(F.col("ml.is_anomaly")), newest)


@query
def disagreement_details(spark, sf_dir):
    newest = alerts.latest(t.triage_rows(spark, sf_dir), "alert_id", "enriched_at")
    return triage.disagreement_rows(t.scored_alerts(spark, sf_dir), newest)


@query
def notify_summary(spark, sf_dir):
    """All routed alerts were fetched; three in ten were attempted."""
    routed = t.scored_alerts(spark, sf_dir).filter(F.col("ml.routing_decision") != "auto-close")
    return alerts.notification_summary(routed, t.notification_rows(spark, sf_dir))


@query
def tactic_counts(spark, sf_dir):
    tactic = group_tactic(F.col("wazuh.rule.groups"))
    return metrics.counts(t.sec_events(spark, sf_dir), tactic.alias("tactic"))


@query
def rule_tables(spark, sf_dir):
    """Every entry of the rank tables and of the rule groups, and texts that miss them, over all events."""
    names = lambda values: F.array(*[F.lit(v) for v in values])
    pick = lambda values: F.element_at(names(values), (F.col("event_id") % len(values) + 1).cast("int"))
    words = [w for w, _ in fv.RULE_GROUP_TACTIC] + [w for _, group in fv.RULE_GROUP_CATEGORY for w in group] + ["other"]
    rows = t.base_events(spark, sf_dir).select(
        pick([*fv.CATEGORY_RANK, "none such"]).alias("category"),
        pick([*fv.CHANNEL_RANK, "windows powershell"]).alias("channel"),
        F.concat(F.lit("x_"), F.upper(pick(words)), F.lit("_y")).alias("group"),
    )
    groups = F.array("group", F.lit("zzz"))
    return rows.select(
        lookup(F.col("category"), fv.CATEGORY_RANK, 0).alias("category_rank"),
        lookup(F.col("channel"), fv.CHANNEL_RANK, 0).alias("channel_rank"),
        group_tactic(groups).alias("tactic"),
        group_category(groups).alias("rule_category"),
    ).groupBy("category_rank", "channel_rank", "tactic", "rule_category").agg(F.count(F.lit(1)).alias("events"))


@query
def prompt_facts(spark, sf_dir):
    """The event lines of the full prompt, for every event, with the whole command text."""
    rows = t.sec_events_with_text(spark, sf_dir).withColumn("score", F.col("value") / 1000.0)
    percentile = F.when(F.col("k") % 9 != 0, F.col("value"))
    shaped = rows.withColumn(
        "ml",
        F.struct(
            F.col("score").alias("anomaly_score"),
            percentile.alias("anomaly_percentile"),
            F.array(
                F.struct(F.lit("proc_rarity").alias("feature"), (F.col("k") / 4.0 - 12).alias("z_score"))
            ).alias("top_features"),
        ),
    )
    return shaped.select("alert_id", prompts.event_lines(F.col).alias("facts"))


@query
def prompt_text(spark, sf_dir):
    """Whole prompts: path, length of the fixed part apart from the facts, and the head."""
    table = triage.prompt_table(t.scored_alerts(spark, sf_dir))
    rate = "statistically unusual for this specific environment"
    return table.select(
        "alert_id",
        "enrichment_path",
        F.contains("prompt", F.lit(rate)).alias("names_rarity"),
        F.contains("prompt", F.lit("attack_technique")).alias("asks_technique"),
        F.contains("prompt", F.lit("investigation_steps")).alias("asks_steps"),
        F.regexp_extract("prompt", r"\(([^()]*percentile[^()]*)\)", 1).alias("rank_text"),
        F.regexp_extract("prompt", r"top_contributing_features: ([^\n]*)", 1).alias("feature_text"),
    )


def _replies(spark, sf_dir) -> DataFrame:
    """Replies made of the conversation turns: prose, fenced JSON, missing keys, bad labels."""
    turn = t.table(spark, sf_dir, "conversations")
    n = F.col("conv_id") * 7 + F.col("turn")
    fields = {
        # where a rule stands behind the alert, a reply may leave these out
        "attack_technique": F.when(n % 8 != 4, F.concat(F.lit("T1"), F.lpad((n % 500).cast("string"), 3, "0"))),
        "attack_tactic": F.when(n % 8 != 6, F.col("role")),
        "description": F.when(n % 16 != 4, F.col("text")),
        "fp_assessment": F.try_element_at(
            F.array(*[F.lit(x) for x in ("low", " Medium ", "HIGH", "unsure")]), (n % 4 + 1).cast("int")
        ),
        "fp_reasoning": F.when(n % 6 != 0, F.lit("seen before")),
        "investigation_steps": F.transform(F.sequence(F.lit(1), (n % 9).cast("int") + 1), lambda i: F.concat(
            F.lit("step "), i.cast("string"))),
    }
    body = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))
    raw = (
        F.when(n % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(n % 5 == 1, F.concat(F.lit("Here you go: "), body, F.lit(" Hope it helps.")))
        .when(n % 5 == 2, F.col("text"))
        .when(n % 5 == 3, F.concat(body, F.lit("}")))
        .otherwise(body)
    )
    alert_id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return turn.select(
        alert_id.alias("alert_id"),
        raw.alias("raw_response"),
        F.when(n % 2 == 0, F.concat(F.lit("R"), n.cast("string"))).alias("rule_id"),
        (n % 100 / 100.0).alias("score"),
        F.when(n % 3 != 0, n % 100 * F.lit(1.0)).alias("percentile"),
        F.when(n % 16 == 12, F.lit("T4242")).alias("known_technique"),
    )


@query
def parse_reply(spark, sf_dir):
    replies = _replies(spark, sf_dir)
    alert = replies.select(
        "alert_id",
        F.struct(F.struct(F.col("known_technique").alias("technique")).alias("mitre")).alias("event"),
        F.struct(
            F.struct(
                F.col("rule_id").alias("id"),
                F.lit("desc").alias("description"),
                F.array(F.lit("defense_evasion")).alias("groups"),
            ).alias("rule")
        ).alias("wazuh"),
        F.struct(F.col("score").alias("anomaly_score"), F.col("percentile").alias("anomaly_percentile")).alias("ml"),
    )
    rows = triage.triage_rows(alert, replies, F.lit(at("2024-02-01")))
    return rows.select(
        "alert_id", "enrichment_path", "attack_technique", "attack_tactic", "description", "fp_assessment",
        "fp_reasoning", F.array_join("investigation_steps", "|").alias("steps"), "combined_confidence",
        "llm_confidence", "if_llm_disagreement", "routing_decision",
    )


# --- normalisation ------------------------------------------------------------------


def _log_lines(spark, sf_dir) -> DataFrame:
    """Log lines of several shapes made of the events."""
    k, user = F.col("k"), F.col("user_id").cast("string")
    address = F.concat(F.lit("10."), (k % 4).cast("string"), F.lit("."), (k % 200).cast("string"), F.lit(".7"))
    return t.base_events(spark, sf_dir).select(
        F.when(
            k % 5 == 0,
            F.to_json(
                F.struct(
                    F.when(k % 10 == 0, t.iso_text(F.col("ts"))).alias("timestamp"),
                    address.alias("source_ip"),
                    F.col("event_type").alias("event_type"),
                    (k / 100.0).alias("anomaly_score"),
                )
            ),
        )
        .when(k % 5 == 1, F.concat(F.lit("  sshd: failed login of "), user, F.lit(" from "), address, F.lit(" port 22")))
        .when(k % 5 == 2, F.concat(F.lit("{broken "), user, F.lit(" 1.2.3.4")))
        .when(k % 5 == 3, F.lit(" \t "))
        .otherwise(F.concat(F.lit("plain "), F.col("event_type")))
        .alias("line")
    )


@query
def log_events(spark, sf_dir):
    rows = normalise.log_lines(_log_lines(spark, sf_dir), F.lit(at("2024-02-01")))
    return rows.groupBy(
        ts_text(F.col("timestamp")).alias("timestamp"),
        "source_ip",
        "event_type",
        (F.col("raw").startswith("{")).alias("raw_is_object"),
    ).agg(
        F.count(F.lit(1)).alias("lines"),
        r6(F.sum("anomaly_score")).alias("score_sum"),
        F.min("raw").alias("first_raw"),
    )


@query
def ip_extract_logs(spark, sf_dir):
    """Every line of every document and page as a log line."""
    texts = (
        spread(t.table(spark, sf_dir, "documents"))
        .select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
        .unionByName(
            t.table(spark, sf_dir, "pages").select(
                F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text")
            )
        )
    )
    lines = texts.select("origin", "id", F.explode(F.split("text", "\n")).alias("line"))
    parsed = normalise.log_lines(lines, F.lit(at("2024-02-01")))
    return parsed.groupBy("origin", "id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("source_ip").alias("with_address"),
        F.min("source_ip").alias("first_address"),
        F.max("source_ip").alias("last_address"),
        F.sum(F.length("raw")).alias("characters"),
    )


@query
def basename_urls(spark, sf_dir):
    return t.table(spark, sf_dir, "pages").select("page_id", base_name(F.col("url")).alias("base"))


def _windows_lines_of(base: DataFrame, *more: Column) -> DataFrame:
    """Raw Windows events of every shape the normaliser knows, made of the events."""
    k = F.col("k")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    iso = t.iso_text(F.col("ts"))
    image = F.concat(F.lit("C:\\Windows\\System32\\"), F.initcap("event_type"), F.lit(".EXE"))
    raw = F.struct(
        F.when(k % 4 == 0, k.cast("string"))
        .when(k % 4 == 1, (4600 + k * 2).cast("string"))
        .when(k % 8 == 2, F.lit("4104"))
        .when(k % 8 == 3, F.lit("x9"))
        .alias("EventID"),
        F.try_element_at(
            F.array(F.lit(t.CHANNELS[0]), F.lit("Security"), F.lit(t.CHANNELS[2]), F.lit("WMI-Log")), k % 4 + 1
        ).alias("Channel"),
        F.when(k % 5 != 0, image).otherwise(F.lit("")).alias("Image"),
        F.when(k % 10 == 0, F.lit("D:/Tools/Alt.exe")).alias("NewProcessName"),
        F.when(k % 3 != 0, F.concat(F.lit("\\Device\\P"), (k % 12).cast("string"), F.lit(".exe"))).alias("ParentImage"),
        F.when(k % 3 == 0, F.lit("C:\\ends\\with\\")).alias("ParentProcessName"),
        F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.concat(F.lit("run "), user)).alias("CommandLine"),
        F.when(k % 2 == 0, F.concat(F.lit("script of "), user)).alias("ScriptBlockText"),
        F.when(k % 6 == 0, F.lit("-")).when(k % 6 == 1, F.lit("")).alias("AccountName"),
        F.when(k % 4 < 2, user).alias("SubjectUserName"),
        F.concat(F.lit("T"), user).alias("TargetUserName"),
        F.when(k % 7 != 0, iso).alias("@timestamp"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("EventTime"),
        F.when(k % 9 != 0, F.concat(F.lit("H"), (F.col("user_id") % 20).cast("string"))).alias("Hostname"),
        F.lit("fallback-host").alias("host"),
        F.when(k % 2 == 0, F.array(F.lit("recorded"), F.col("event_type"))).alias("tags"),
    )
    whole = F.to_json(raw)
    line = F.when(k % 20 == 19, F.concat(F.lit("{bad "), whole)).when(k % 20 == 18, F.lit("  ")).otherwise(whole)
    return base.select(
        F.lit("raw").alias("source_dataset"), F.lit("events").alias("member"), F.col("event_id").alias("line_no"),
        line.alias("line"), *more,
    )


def _windows_lines(spark, sf_dir) -> DataFrame:
    return _windows_lines_of(t.from_events(spread(t.table(spark, sf_dir, "events"))))


def _flat_events(events: DataFrame, *more: Column) -> DataFrame:
    return events.select(
        "alert_id",
        ts_text(F.col("ts")).alias("ts"),
        F.col("host.name").alias("host"),
        F.col("user.name").alias("user_name"),
        F.col("process.name").alias("process"),
        F.col("process.parent.name").alias("parent"),
        F.col("event.category").alias("category"),
        F.col("event.id").alias("event_id"),
        "source_dataset",
        *more,
    )


@query
def normalise_events(spark, sf_dir):
    events = normalise.windows_events(_windows_lines(spark, sf_dir))
    return _flat_events(
        events,
        F.col("process.command_line").alias("command_line"),
        F.col("event.channel").alias("channel"),
        F.array_join("tags", ",").alias("tags"),
        F.col("_bad_reason").isNotNull().alias("is_bad"),
    )


#: A task writes about this many lines, or joins the ids of as many.
_LINES_A_TASK = 250_000


def _write_by_day(rows: DataFrame, n: int, folder: str, lines: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Write the ``n`` ``lines`` of ``rows`` in a folder per day; what a task sorts does not grow with them, nor with one day's.

    Rows are dealt out before lines are made of them, which are much longer; by all of their columns, as without any a
    task sorts what it has read first.
    """
    tasks = max(2, -(-n // _LINES_A_TASK))
    lines(rows.repartition(tasks, *rows.columns)).select("day", "value").write.partitionBy("day").text(folder)


@query
def reingest_ids(spark, sf_dir):
    """Raw lines in files by weekday, taken in twice: first four of the files, then all, split in another way.

    Lines that are events, their distinct ids, and ids that both times gave.
    """
    day = F.concat(F.lit("day"), F.dayofweek("ts").cast("string"))
    events = t.table(spark, sf_dir, "events")
    # equal lines too: every line is written twice
    twice = lambda rows: _windows_lines_of(t.from_events(rows), day.alias("day")).select("day", F.explode(F.array("line", "line")).alias("value"))
    folder = scratch_path(spark, "raw-lines")
    n = 2 * events.count()
    _write_by_day(events, n, folder, twice)
    # an id is a hash in hexadecimal digits; its bytes take half of them
    ids = lambda *paths: cut(
        normalise.windows_events(archives.json_lines(spark, *paths)).select(F.unhex("alert_id").alias("alert_id"))
    )
    by_id = (max(spark.sparkContext.defaultParallelism, -(-n // _LINES_A_TASK)), "alert_id")
    first = ids(*[f"{folder}/day=day{n}" for n in range(2, 6)])
    with setting(spark, "spark.sql.files.maxPartitionBytes", "200000"):
        again = ids(f"{folder}/day=*")
    return again.repartition(*by_id).join(first.select("alert_id", F.lit(1).alias("was")).repartition(*by_id), "alert_id", "left").agg(
        F.count(F.lit(1)).alias("lines"), F.count_distinct("alert_id").alias("ids"), F.count("was").alias("both")
    )


def _alert_lines_of(base: DataFrame) -> DataFrame:
    """Raw endpoint alerts in both layouts, with string and list fields, made of the events."""
    k = F.col("k")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    text = lambda s: F.to_json(F.struct(s.alias("x")))
    quoted = lambda s: F.regexp_extract(text(s), r'^\{"x":(.*)\}$', 1)
    groups = (
        F.when(k % 6 == 0, F.lit('"Windows_Logon"'))
        .when(k % 6 == 1, F.lit('["windows","Sysmon_Event1"]'))
        .when(k % 6 == 2, F.lit('["firewall"]'))
        .when(k % 6 == 3, F.lit('["RegScan","x"]'))
        .when(k % 6 == 4, F.lit('["powershell"]'))
        .otherwise(F.lit("[]"))
    )
    mitre = (
        F.when(k % 4 == 0, F.lit('{"technique":["T1003","T1059"]}'))
        .when(k % 4 == 1, F.lit('{"id":"T1021"}'))
        .when(k % 4 == 2, F.lit('{"technique":[],"id":["T1110"]}'))
        .otherwise(F.lit("{}"))
    )
    agent = F.concat(F.lit('{"id":"'), (F.col("user_id") % 20).cast("string"), F.lit('","name":"Host'),
                     (F.col("user_id") % 20).cast("string"), F.lit('"}'))
    rule = F.concat(F.lit('{"id":'), k.cast("string"), F.lit(',"description":'), quoted(F.col("event_type")),
                    F.lit(',"level":'), (k % 16).cast("string"), F.lit(',"groups":'), groups, F.lit(',"mitre":'),
                    mitre, F.lit("}"))
    win = F.when(
        k % 2 == 0, F.concat(F.lit('{"image":"C:\\\\X\\\\A.EXE","parentImage":"","ParentImage":"c:/p.exe"'),
                             F.lit(',"targetUserName":'), quoted(user), F.lit("}"))
    ).otherwise(F.lit('{"Image":"D:/b.exe","subjectUserName":""}'))
    head = F.concat(F.lit('"data":{"win":{"eventdata":'), win, F.lit('}},"syscheck":{"uname_after":"svc"},'),
                    F.when(k % 7 == 0, F.lit('"timestamp":')).otherwise(F.lit('"@timestamp":')),
                    quoted(t.iso_text(F.col("ts"))))
    body = (
        F.when(k % 3 == 0, F.concat(F.lit('"wazuh":{"agent":'), agent, F.lit(',"rule":'), rule, F.lit("}")))
        .when(k % 3 == 1, F.concat(F.lit('"agent":'), agent, F.lit(',"rule":'), rule))
        .otherwise(F.concat(F.lit('"hostname":"bare","rule":'), rule))
    )
    return base.select(
        F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("upstream_id"),
        F.concat(F.lit("{"), head, F.lit(","), body, F.lit("}")).alias("line"),
    )


def _alert_lines(spark, sf_dir) -> DataFrame:
    return _alert_lines_of(t.from_events(spread(t.table(spark, sf_dir, "events"))))


def _flat_alerts(rows: DataFrame) -> DataFrame:
    return _flat_events(
        rows,
        F.col("event.mitre.technique").alias("technique"),
        F.col("wazuh.rule.description").alias("description"),
        F.col("wazuh.rule.level").alias("level"),
        F.array_join("wazuh.rule.groups", ",").alias("groups"),
        F.col("wazuh.agent.name").alias("agent_name"),
    )


@query
def normalise_alerts(spark, sf_dir):
    return _flat_alerts(normalise.endpoint_alerts(_alert_lines(spark, sf_dir), "upstream_id"))


@query
def union_sources(spark, sf_dir):
    merged = normalise.union_sources(
        normalise.windows_events(_windows_lines(spark, sf_dir)),
        normalise.endpoint_alerts(_alert_lines(spark, sf_dir), "upstream_id"),
    )
    return metrics.counts(
        merged, "source_dataset", F.col("event.category").alias("category"),
        F.col("event.mitre.technique").alias("technique"),
    )


@query
def coerce_round(spark, sf_dir):
    events = t.table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise((F.col("value") / 7.0).cast("string"))
    number = to_number(text)
    return events.select("event_id", F.round(number, 6).alias("score"), F.round(number, 2).alias("percentile"))


# --- scans --------------------------------------------------------------------------


@query
def full_scan(spark, sf_dir):
    rows = scans.all_events(t.sec_events(spark, sf_dir))
    return rows.select("alert_id", ts_text(F.col("ts")).alias("ts"), "source_dataset")


@query
def incremental_scan(spark, sf_dir):
    rows = scans.events_since(t.sec_events(spark, sf_dir), at("2024-01-20"))
    return metrics.cursor(rows).select(ts_text(F.col("last_seen")).alias("last_seen"), "events")


@query
def current_window(spark, sf_dir):
    rows = scans.events_last_days(t.sec_events(spark, sf_dir), at("2024-01-31"))
    return metrics.counts(rows, "event_date").withColumn("event_date", F.col("event_date").cast("string"))


@query
def lookback_scan(spark, sf_dir):
    rows = t.base_events(spark, sf_dir).withColumnRenamed("ts", "timestamp")
    seen = legacy.look_back(rows, at("2024-01-30"), 24)
    return seen.select("event_id", "event_type", F.col("user_id").alias("source_ip"))


@query
def recent_rows(spark, sf_dir):
    rows = scans.recent_rows(t.sec_events(spark, sf_dir), "ts", 500, "alert_id")
    return rows.select("alert_id", ts_text(F.col("ts")).alias("ts"))


@query
def last_valid_run(spark, sf_dir):
    """Runs made of the orders: some trial runs, some failed, some unfinished."""
    orders = t.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    runs = orders.select(
        F.concat(F.lit("run"), F.lpad(key.cast("string"), 9, "0")).alias("run_id"),
        F.when(key % 3 == 0, F.lit("enrichment")).otherwise(F.lit("retrain")).alias("job_type"),
        F.when(key % 7 != 0, F.col("o_orderdate").cast("timestamp")).alias("completed_at"),
        F.when(key % 5 == 0, F.lit(True)).when(key % 5 == 1, F.lit(False)).alias("dry_run"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("failed"))).otherwise(
            F.array().cast("array<string>")
        ).alias("errors"),
    )
    row = ledger.last_valid_run(runs)
    return row.withColumn("completed_at", ts_text(F.col("completed_at")))


# --- coverage -----------------------------------------------------------------------


def _steps(spark, sf_dir) -> DataFrame:
    return coverage.executed_steps(t.exec_links(spark, sf_dir), F.col("poll"))


def _results(spark, sf_dir) -> DataFrame:
    found = coverage.anomalous_events(t.scored_alerts(spark, sf_dir), 0.65)
    return coverage.step_results(_steps(spark, sf_dir), found)


@query
def exec_steps(spark, sf_dir):
    return _steps(spark, sf_dir).withColumn("executed_at", ts_text(F.col("executed_at")))


@query
def detections_90s(spark, sf_dir):
    return _results(spark, sf_dir).withColumn("executed_at", ts_text(F.col("executed_at")))


@query
def top_detections(spark, sf_dir):
    found = coverage.anomalous_events(t.scored_alerts(spark, sf_dir), 0.65)
    rows = coverage.top_detections(_steps(spark, sf_dir), found)
    return rows.withColumn("detected_at", ts_text(F.col("detected_at")))


@query
def detection_scorecard(spark, sf_dir):
    return coverage.scorecard(_results(spark, sf_dir))


@query
def missed_techniques(spark, sf_dir):
    return coverage.missed_techniques(_results(spark, sf_dir))


@query
def detection_split(spark, sf_dir):
    return coverage.detection_split(_results(spark, sf_dir))


@query
def step_table(spark, sf_dir):
    return coverage.step_table(_results(spark, sf_dir))


def _tactic() -> Column:
    """Tactic of a technique, from its number."""
    number = F.regexp_extract("technique_id", r"^T1(\d+)$", 1).try_cast("int")
    names = [tactic for _, tactic in fv.RULE_GROUP_TACTIC]
    return F.coalesce(
        F.try_element_at(F.array(*[F.lit(n) for n in names]), number % len(names) + 1), F.lit(fv.TACTIC_DEFAULT)
    )


@query
def coverage_by_tactic(spark, sf_dir):
    return coverage.tactic_coverage(_results(spark, sf_dir), _tactic())


# --- drift --------------------------------------------------------------------------

_DRIFT_FROM = "2024-01-21"


def _windows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Features before and from the boundary, each against its own corpus."""
    events = t.searched_events(spark, sf_dir)
    boundary = F.lit(at(_DRIFT_FROM))
    return tuple(
        cut(features.feature_matrix(events.filter(side))) for side in (F.col("ts") < boundary, F.col("ts") >= boundary)
    )


def _running(spark, sf_dir) -> DataFrame:
    return drift.cumulative_windows(drift.window_histogram(*_windows(spark, sf_dir)))


@query
def drift_ks(spark, sf_dir):
    return drift.distances(_running(spark, sf_dir)).select("feature", r6("ks").alias("ks"))


@query
def drift_w1(spark, sf_dir):
    rows = drift.drift_table(_running(spark, sf_dir))
    return rows.select(
        "feature", F.round("w1", 5).alias("w1"), F.round("w1_norm", 5).alias("w1_norm"), "drifted"
    )


@query
def drift_psi(spark, sf_dir):
    return drift.stability_index(_running(spark, sf_dir)).select("feature", r6("psi").alias("psi"))


def _gates(spark, sf_dir) -> DataFrame:
    reference, current = _windows(spark, sf_dir)
    running = drift.cumulative_windows(drift.window_histogram(reference, current))
    return drift.gate_rows(drift.drift_table(running), F.lit(reference.count()), F.lit(current.count()))


@query
def drift_gates(spark, sf_dir):
    return _gates(spark, sf_dir)


@query
def drift_verdict(spark, sf_dir):
    return drift.gate_verdict(_gates(spark, sf_dir))


@query
def quality_profile(spark, sf_dir):
    rows = drift.quality_profile(_features(spark, sf_dir))
    exact = ["feature", "nulls", "n", "distinct_values", "is_constant"]
    return rows.select(*exact, *[r6(c).alias(c) for c in rows.columns if c not in exact])


@query
def drift_from_days(spark, sf_dir):
    """Drift of the days from the boundary, and the profile of all days, from counts by day.

    The events come in two batches that share their days, the second of them twice.
    """
    events, path = t.searched_events(spark, sf_dir), scratch_path(spark, "days")
    half = F.crc32("alert_id") % 2
    for batch in (0, 1, 1):
        day_state.add_days(events.filter(half == batch), path, batch)
    counts, boundary = day_state.days(spark, path), at(_DRIFT_FROM).date()
    windows = day_state.window_values(counts, after=boundary), day_state.window_values(counts, boundary)
    running = drift.cumulative_windows(day_state.drift_histogram(*windows))
    profile = drift.profile_of(day_state.window_values(counts))
    exact = ["feature", "nulls", "n", "distinct_values", "is_constant"]
    found = drift.drift_table(running).select(
        "feature", r6("ks").alias("ks"), F.round("w1", 5).alias("w1"), F.round("w1_norm", 5).alias("w1_norm"), "drifted", r6("psi").alias("psi")
    )
    return found.join(profile.select(*exact, *[r6(c).alias(c) for c in profile.columns if c not in exact]), "feature")


# --- models -------------------------------------------------------------------------


def _legacy_rows(spark, sf_dir) -> DataFrame:
    base = t.base_events(spark, sf_dir)
    return base.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("alert_id"),
        F.when(F.col("k") != 0, F.col("event_type")).alias("event_type"),
        F.concat(F.lit("10.0."), (F.col("user_id") / 250).cast("int").cast("string"), F.lit("."),
                 (F.col("user_id") % 250).cast("string")).alias("source_ip"),
    )


@query
def categorical_codes(spark, sf_dir):
    rows = legacy.categorical_codes(_legacy_rows(spark, sf_dir))
    return rows.select("alert_id", "event_type_code", "source_ip_code")


@query
def lof_scores(spark, sf_dir):
    rows = legacy.legacy_scores(_legacy_rows(spark, sf_dir), "lof")
    # Coinciding points make factors of very different size, so the logarithm is compared.
    return rows.select("alert_id", (F.round(F.log("anomaly_score"), 6) + 0.0).alias("log_factor"))


@query
def legacy_scores(spark, sf_dir):
    return legacy.legacy_scores(_legacy_rows(spark, sf_dir)).withColumn("anomaly_score", r6("anomaly_score"))


def _flat_scores(scores: DataFrame) -> DataFrame:
    tops = F.transform("top_features", lambda f: f["feature"])
    return scores.withColumn("top_features", F.array_join(tops, ","))


@query
def legacy_job(spark, sf_dir):
    """Two runs of the job over different days, the first of them twice: what its table holds."""
    base = t.base_events(spark, sf_dir).select(F.concat(F.lit("e"), "event_id").alias("alert_id"), F.col("ts").alias("timestamp"))
    logs = _legacy_rows(spark, sf_dir).join(base, "alert_id")
    path = scratch_path(spark, "legacy-scores")
    for run, day in (("a", "2024-01-10"), ("b", "2024-01-12"), ("a", "2024-01-10"), ("none", "1999-01-01")):
        legacy_job_plan.score_logs(logs, at(day), path, run, hours=36)
    rows = spark.read.parquet(path)
    return rows.select("run_id", "alert_id", ts_text(F.col("timestamp")).alias("timestamp"), r6("anomaly_score").alias("anomaly_score"), "method")


def _forest(spark, sf_dir) -> tuple[DataFrame, Forest]:
    """Scaled features of all events and the forest grown on them."""
    z = _z(spark, sf_dir)
    slots, size = fit_trees(z, fv.FEATURES, "alert_id", z.count(), trees=fv.TREES, seed=fv.SEED)
    return z, Forest.of(slots, fv.FEATURES, size)


@query
def forest_slots(spark, sf_dir):
    """The forest as a relation: its splits and its leaves (the first slot of those that repeat one)."""
    _, forest = _forest(spark, sf_dir)
    slots = forest.slots(spark)
    split = F.col("threshold") < float("inf")
    up = slots.filter(split).select("tree", F.explode(F.array(F.col("node") * 2 + 1, F.col("node") * 2 + 2)).alias("node"))
    ends = up.unionByName(slots.filter("node = 0").select("tree", "node"))
    named = F.element_at(F.array(*[F.lit(f) for f in fv.FEATURES]), F.col("feature") + 1)
    return slots.join(ends, ["tree", "node"], "left_semi").select(
        "tree", "node", F.when(split, named).alias("feature"),
        F.when(split, r6("threshold") + 0.0).alias("threshold"), F.when(~split, r6("path")).alias("path"),
    )


@query
def forest_walk(spark, sf_dir):
    """Raw scores of all events by column expressions alone."""
    z, forest = _forest(spark, sf_dir)
    whole = F.lit(-len(forest.path) * average_path(forest.sample_size))
    return forest.walk(spread(z)).select("alert_id", r6(F.log2(-F.col("raw")) * whole).alias("total_path"), F.round("raw", 9).alias("raw"))


@query
def iforest_scores(spark, sf_dir):
    return _flat_scores(retrain_plan.retrain(t.searched_events(spark, sf_dir), "m").scores)


_RUNS: dict[tuple[str, str], str] = {}


def _stored_run(spark, sf_dir) -> str:
    """Where the run over the days before the boundary is stored: trained once in a session, as one would nightly."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        events = t.searched_events(spark, sf_dir).filter(F.col("ts") < F.lit(at(_DRIFT_FROM)))
        root = scratch_path(spark, "runs")
        retrain_plan.store(retrain_plan.retrain(events, "m"), events, root, at(_DRIFT_FROM), at(_DRIFT_FROM))
        _RUNS[key] = root
    return _RUNS[key]


def _fresh_events(spark, sf_dir) -> DataFrame:
    """The events from the boundary on, with their command texts searched."""
    return t.sec_events_with_indicators(spark, sf_dir).filter(F.col("ts") >= F.lit(at(_DRIFT_FROM)))


@query
def iforest_incremental(spark, sf_dir):
    """The days after the boundary, scored with the numbers that the stored run of the days before it saved."""
    model, frequencies = retrain_plan.stored_model(spark, _stored_run(spark, sf_dir), "m")
    return _flat_scores(retrain_plan.score_new(model, _fresh_events(spark, sf_dir), baseline="training", frequencies=frequencies))


@query
def incremental_batch(spark, sf_dir):
    """The days after the boundary, scored with the stored model relative to themselves."""
    model, _ = retrain_plan.stored_model(spark, _stored_run(spark, sf_dir), "m")
    return _flat_scores(retrain_plan.score_new(model, cut(_fresh_events(spark, sf_dir))))


@query
def round_trips(spark, sf_dir):
    """Every table written and read back through its own writer and reader: rows, and a sum over what was read."""
    path = lambda name: scratch_path(spark, name)
    events, sent, triaged = path("events"), path("notifications"), path("triage")
    tables.append_events(t.sec_events(spark, sf_dir), events)
    tables.append_triage(t.triage_rows(spark, sf_dir).filter("enrichment_path = 'A'"), triaged)
    tables.append_triage(t.triage_rows(spark, sf_dir).filter("enrichment_path = 'B'"), triaged)
    tables.append_log(t.notification_rows(spark, sf_dir), sent)
    scored = path("scores")
    for _ in range(2):  # a repeated run replaces itself
        tables.write_scores(t.score_runs(spark, sf_dir), scored)
    snapshots = path("snapshots")
    for run in ("20240101_000000", "20240102_000000"):
        tables.write_snapshot(t.base_events(spark, sf_dir).select("event_id", "value").filter(F.lit(run) > "20240101_9"), snapshots, run)
    ledger_rows = reduce(DataFrame.unionByName, [ledger.run_row(spark, "retrain", at(f"2024-01-0{d}"), at(f"2024-01-0{d}"), "{}", run_id=f"2024010{d}_000000") for d in (1, 2)])
    cards = path("scorecards")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        results = _results(spark, sf_dir).filter(F.col("executed_at") < F.lit(at(day)) + F.expr("interval 15 days"))
        tables.write_scorecard(coverage.scorecard(results), results, cards, day)
    lines = path("alert-lines")
    _alert_lines(spark, sf_dir).select("line").write.text(lines)
    runs = path("run-files")
    for run in ("20240101_000000", "20240102_000000"):  # a file holds one run
        ledger_rows.filter(F.col("run_id") == run).coalesce(1).write.mode("append").json(runs)
    logs = path("log-lines")
    _log_lines(spark, sf_dir).select("line").write.text(logs)
    read = {
        "events": spark.read.parquet(events).select(F.col("k").alias("x")),
        "events_since": scans.events_since(spark.read.parquet(events), at("2024-01-20")).select(F.col("k").alias("x")),
        "triage": spark.read.schema(schemas.TRIAGE).parquet(triaged).select("combined_confidence"),
        "notifications": spark.read.schema(schemas.NOTIFICATION).json(sent).select((F.col("status") == "sent").cast("int")),
        "scores": spark.read.parquet(scored).select("ml.anomaly_score"),
        "snapshot": scans.feature_snapshot(spark, snapshots, ledger=ledger_rows).select("value"),
        "scorecard": scans.latest_scorecard(spark.read.parquet(f"{cards}/summary")).select("detected"),
        "scorecard_steps": spark.read.parquet(f"{cards}/steps").filter("report_date = '2024-01-01'").select(F.lit(1)),
        "alert_lines": scans.alert_lines(spark, at("2024-01-20"), lines).select(F.lit(1)),
        "run_files": ledger.last_valid_run(scans.run_records(spark, runs)).select(F.substring("run_id", 1, 8).cast("bigint")),
        "log_lines": archives.text_lines(spark, logs).select(F.lit(1)),
    }
    rows = [
        df.toDF("x").agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("x").cast("double")), 3).alias("total"))
        for name, df in read.items()
    ]
    return reduce(DataFrame.unionByName, rows)


@query
def stored_run(spark, sf_dir):
    """What readers see of a run that is stored twice, beside one that failed and one that died between its writes."""
    events = t.searched_events(spark, sf_dir)
    root, run = scratch_path(spark, "runs"), retrain_plan.retrain(events, "m")
    retrain_plan.store(run, events, root, at(_DRIFT_FROM), at(_DRIFT_FROM))
    run.features.select(F.lit("dead").alias("run_id"), "*").write.parquet(manifest.new_folder(root))
    retrain_plan.store_unfinished(spark, "failed", root, at(_DRIFT_FROM), at(_DRIFT_FROM), ["no space"])
    retrain_plan.store(run, events, root, at(_DRIFT_FROM), at(_DRIFT_FROM))
    model, frequencies = retrain_plan.stored_model(spark, root, "m")
    parts = {part: retrain_plan.stored(spark, root, part) for part in ("scores", "run_metrics", "run_ledger")}
    parts |= {
        "anomalies": parts["scores"].filter("ml.is_anomaly"),
        "feature_snapshot": retrain_plan.stored_snapshot(spark, root),
        "trees": model.forest.slots(spark).select("tree").distinct(),
        "frequencies": frequencies.table,
    }
    rows = [p.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n")) for name, p in parts.items()]
    return reduce(DataFrame.unionByName, rows)


# --- streams ------------------------------------------------------------------------


def _events_stream(spark, sf_dir) -> DataFrame:
    """The events file as a stream."""
    schema = t.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _streamed(spark: SparkSession, sf_dir: str):
    """Let the views of the given tables read ``events`` as a stream."""
    return t.from_events(_events_stream(spark, sf_dir))


@query
def stream_bridge(spark, sf_dir):
    """Endpoint alerts normalised by a stream that stops when it has caught up."""
    lines = _alert_lines_of(_streamed(spark, sf_dir)).select("line")
    out, checkpoint = scratch_path(spark, "bridge"), scratch_path(spark, "bridge-checkpoint")
    run_available(alert_events(lines), out, checkpoint).awaitTermination()
    rows = spark.read.parquet(out)
    return metrics.counts(rows, F.col("event.category").alias("category"), F.col("host.name").alias("host"))


@query
def stream_bridge_skips(spark, sf_dir):
    """Alert lines of three files, some of them cut off, plain text or blank: what each batch took in and rejected."""
    number = F.substring("upstream_id", 2, 20).cast("bigint")
    lines = _alert_lines(spark, sf_dir).select(
        (number % 3).alias("file"),
        F.when(number % 20 == 7, F.lit("  "))
        .when(number % 10 == 3, F.expr("substring(line, 1, length(line) - 2)"))
        .when(number % 10 == 4, F.concat(F.lit("text "), "upstream_id"))
        .otherwise(F.col("line")).alias("value"),
    )
    incoming, folder, checkpoint = scratch_path(spark, "alerts"), scratch_path(spark, "bridged"), scratch_path(spark, "bridge-checkpoint")
    for file in range(3):
        lines.filter(F.col("file") == file).select("value").coalesce(1).write.mode("append").text(incoming)
    bridge_stream(text_stream(spark, incoming, files_per_batch=1), folder, checkpoint).awaitTermination()
    records = spark.read.parquet(f"{folder}/run_ledger")
    counts = records.select(
        F.regexp_extract("run_id", r"(\d+)$", 1).cast("int").alias("batch"),
        *[F.get_json_object("result", f"$.{n}").cast("bigint").alias(n) for n in ("indexed", "skipped")],
    )
    rejected = spark.read.parquet(f"{folder}/rejected").groupBy("batch").agg(
        F.count_if(F.col("cause") == "malformed JSON").alias("malformed"), F.count_if(F.col("cause") == "not an object").alias("no_object")
    )
    events = spark.read.parquet(f"{folder}/events").groupBy("batch").agg(F.count_distinct("event.id").alias("rules"))
    return counts.join(rejected, "batch").join(events, "batch")


@query
def stream_notify(spark, sf_dir):
    """The log of messages for two rounds of triage, with a restart between them and the second batch coming twice.

    Every fifth alert cannot be delivered at the first try.
    """
    rows = t.triage_rows(spark, sf_dir)
    incoming, log, checkpoint = scratch_path(spark, "triage"), scratch_path(spark, "notify-log"), scratch_path(spark, "notify-checkpoint")
    number = F.substring("alert_id", 2, 20).cast("bigint")
    deliver = lambda messages: messages.select("alert_id", ((number % 5 != 0) | (F.col("attempt") > 1)).alias("ok"))
    for early in (True, False):
        # the triage rows of an alert stand in the order of their hours
        first = F.row_number().over(Window.partitionBy("alert_id").orderBy("enriched_at")) == 1
        part = rows.withColumn("_first", first).filter(F.col("_first") == early).drop("_first")
        part.coalesce(1).write.mode("append").parquet(incoming)
        stream = spark.readStream.schema(rows.schema).parquet(incoming)
        notify_stream(stream, log, deliver, checkpoint).awaitTermination()
    notify_batch(part, 1, log, deliver)
    return notification_log(spark, log).select("batch", "alert_id", "attempt", "status", "combined_confidence")


@query
def stream_detections(spark, sf_dir):
    """Steps of all polls and anomalies as streams; a last step, long after, closes every window before it."""
    steps = coverage.step_columns(t.exec_links_of(_streamed(spark, sf_dir)))
    found = coverage.anomalous_events(t.scored_of(_streamed(spark, sf_dir)), 0.65)
    closing = scratch_path(spark, "closing")
    end = F.to_timestamp(F.lit("2200-01-01 00:00:00"))
    last = t.base_events(spark, sf_dir).agg(F.count("*").alias("n")).select(
        F.lit("closing").alias("link_id"), F.lit("closing").alias("host"), end.alias("executed_at"), end.alias("event_ts"), F.lit(0.0).alias("score")
    )
    last.write.parquet(closing)
    closes = spark.readStream.schema(last.schema).parquet(closing)
    steps = steps.unionByName(closes.select("link_id", "host", "executed_at"), allowMissingColumns=True)
    found = found.unionByName(closes.select("host", "event_ts", "score"), allowMissingColumns=True)
    out, checkpoint = scratch_path(spark, "detections"), scratch_path(spark, "detections-checkpoint")
    with stateful(spark):
        stream = run_available(monitored_steps(steps, found), out, checkpoint)
    stream.awaitTermination()
    return spark.read.parquet(out).withColumn("executed_at", ts_text(F.col("executed_at")))
