import random

import pytest
from conftest import utc
from pyspark.sql import functions as F

from embertrace.functions import prompts
from embertrace.functions.replies import parsed_reply
from embertrace.operators import alerts, triage

ALERT = """
    alert_id string, ts timestamp, host struct<name: string>, user struct<name: string>,
    process struct<name: string, command_line: string, parent: struct<name: string>>,
    event struct<category: string, channel: string, mitre: struct<technique: string>>,
    wazuh struct<rule: struct<id: string, description: string, groups: array<string>>>, source_dataset string,
    ml struct<anomaly_score: double, anomaly_percentile: double, is_anomaly: boolean, routing_decision: string,
              top_features: array<struct<feature: string, z_score: double>>>
"""
TOPS = [("user_rarity", 2.06), ("cmd_len", -1.91), ("cmd_has_download", 0.774)]


def alert(id="a", proc="lister.bin", cmd="list all", score=0.95, pct=98.5, tops=TOPS, rule=None, technique=None, anomaly=True):
    return (
        id, utc("2024-01-01T00:00:00"), ("H",), ("U",), (proc, cmd, ("panel.bin",)),
        ("process_creation", "Sysmon", (technique,)), (rule,), "test", (score, pct, anomaly, "tier-1", tops),
    )


def prompt(spark, *args, **kwargs):
    return triage.prompt_table(spark.createDataFrame([alert(*args, **kwargs)], ALERT)).first()


def test_full_prompt(spark):
    row = prompt(spark, proc="grab.bin", cmd="grab --all b3duIHRlc3Q", score=0.8642, pct=91.7)
    assert row["enrichment_path"] == "B"
    for part in (
        "grab.bin", "grab --all b3duIHRlc3Q", "anomaly_score: 0.8642  (91.7th percentile)",
        "statistically unusual for this specific environment", "JSON", "attack_technique", "investigation_steps",
        "user_rarity (z=+2.06, above baseline); cmd_len (z=-1.91, below baseline); cmd_has_download (z=+0.77",
    ):
        assert part in row["prompt"]


def test_prompt_fallbacks(spark):
    empty = spark.createDataFrame([("a",) + (None,) * 8], ALERT)
    text = triage.prompt_table(empty).first()["prompt"]
    for part in ("process.name: unknown", "(not recorded)", "percentile unavailable", "not available", "0.0000"):
        assert part in text


def test_rule_prompt(spark):
    row = prompt(spark, rule=("92000", "odd logon", []), pct=None)
    assert row["enrichment_path"] == "A"
    assert "92000" in row["prompt"] and "odd logon" in row["prompt"] and "high percentile" in row["prompt"]
    assert "attack_technique" not in row["prompt"]
    assert len(row["prompt"]) < 0.6 * len(prompt(spark)["prompt"])
    assert prompt(spark, rule=("  ", "blank", []))["enrichment_path"] == "B"


def test_decimals_match_python(spark):
    pick = random.Random(4)
    numbers = [69.85, 0.125, 0.375, 2.675, 1.005, 0.0, 100.0, 98.25, 98.35, 0.05, -1.685, -0.125, 1e-9, 12345.675]
    numbers += [round(pick.uniform(-150, 150), 3) for _ in range(3000)] + [pick.uniform(0, 1) for _ in range(500)]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, x double")
    x = F.col("x")
    rows = df.select(
        "i", prompts.decimals(x, 1).alias("a"), prompts.decimals(x, 4).alias("b"), prompts.decimals(x, 2, True).alias("c")
    ).collect()
    for r in rows:
        n = numbers[r["i"]]
        assert (r["a"], r["b"], r["c"]) == (f"{n:.1f}", f"{n:.4f}", f"{n:+.2f}"), n


GOOD = """{"attack_technique": "T1218.011", "attack_tactic": "Execution", "description": "d", "fp_assessment": "%s",
 "fp_reasoning": "r", "investigation_steps": %s}"""


def parse(spark, raw, backed=False):
    df = spark.createDataFrame([(raw, backed)], "raw string, backed boolean")
    return df.select(parsed_reply(F.col("raw"), F.col("backed")).alias("r")).first()["r"]


def test_reply_forms(spark):
    body = GOOD % ("low", '["a", "b"]')
    for raw in (body, f"```json\n{body}\n```", f"Sure, here: {body} Anything else?"):
        row = parse(spark, raw)
        assert row["attack_technique"] == "T1218.011" and row["investigation_steps"] == ["a", "b"]


@pytest.mark.parametrize(
    "raw",
    [
        "I cannot tell.", "", None, '{"fp_assessment": "low"}', GOOD % ("low", "[]"), GOOD % ("low", '"text"'),
        (GOOD % ("low", '["a"]')) + "}", (GOOD % ("low", '["a"]')) + " and " + (GOOD % ("low", '["a"]')),
        (GOOD % ("low", '["a"]')).replace('"', "'"), (GOOD % ("low", '["a"]'))[:-3] + "}",
    ],
)
def test_unusable_replies(spark, raw):
    assert parse(spark, raw) is None


def test_reply_labels_and_steps(spark):
    assert parse(spark, GOOD % (" LOW ", '["a"]'))["fp_assessment"] == "low"
    assert parse(spark, GOOD % ("certainly", '["a"]'))["fp_assessment"] == "medium"
    many = "[" + ", ".join(f'"{i}"' for i in range(10)) + "]"
    assert parse(spark, GOOD % ("high", many))["investigation_steps"] == ["0", "1", "2", "3", "4"]
    assert parse(spark, GOOD % ("high", "[1, true]"))["investigation_steps"] == ["1", "true"]
    short = '{"fp_assessment": "high", "fp_reasoning": "r", "investigation_steps": ["x"]}'
    assert parse(spark, short) is None and parse(spark, short, backed=True)["fp_assessment"] == "high"


def confidence(spark, score, pct, label):
    df = spark.createDataFrame([(score, pct, label)], "s double, p double, l string")
    return df.select(*triage.confidence_columns(F.col("s"), F.col("p"), F.col("l"))).first()


def test_confidence(spark):
    top = confidence(spark, 0.95, 99.0, "low")
    assert top["routing_decision"] == "high_priority" and top["combined_confidence"] == round((0.95 * 0.99) ** (1 / 3), 4)
    assert confidence(spark, 0.95, 99.0, "high")["combined_confidence"] < 0.7
    assert confidence(spark, 0.9, 95.0, "high")["if_llm_disagreement"]
    assert not confidence(spark, 0.6, 60.0, "high")["if_llm_disagreement"]
    assert confidence(spark, 0.3, 30.0, "high")["routing_decision"] == "auto-close"
    assert confidence(spark, 0.8, None, "low") == confidence(spark, 0.8, 80.0, "low")
    assert confidence(spark, 0.8, 80.0, "who knows")["llm_confidence"] == 0.5
    assert confidence(spark, 0.8, 80.0, " HIGH ")["llm_confidence"] == 0.2


def test_triage_fills_from_the_rule(spark):
    rows = spark.createDataFrame(
        [
            alert("a", rule=("9", "odd", ["lateral"]), technique="T1021"),
            alert("b", rule=("9", "odd", ["misc"])),
            alert("c"),
            alert("d"),
            alert("e"),
        ],
        ALERT,
    )
    short = '{"fp_assessment": "low", "fp_reasoning": "r", "investigation_steps": ["x"]}'
    replies = spark.createDataFrame(
        [("a", short), ("b", short), ("c", short), ("d", GOOD % ("high", '["x"]'))], "alert_id string, raw_response string"
    )
    done = triage.triage_rows(rows, replies, F.current_timestamp()).cache()
    got = {r["alert_id"]: r for r in done.collect()}
    assert set(got) == {"a", "b", "d"}
    assert (got["a"]["attack_technique"], got["a"]["attack_tactic"]) == ("T1021", "Lateral Movement")
    assert got["a"]["enrichment_path"] == "A" and "odd" in got["a"]["description"]
    assert (got["b"]["attack_technique"], got["b"]["attack_tactic"]) == ("wazuh:9", "Unknown")
    assert got["d"]["attack_technique"] == "T1218.011" and got["d"]["enrichment_path"] == "B"
    summary = triage.triage_summary(rows, done).first()
    assert tuple(summary) == (5, 3, 2, 1)
    assert [r["alert_id"] for r in triage.disagreement_rows(rows, done).collect()] == ["d"]
    assert {r["alert_id"] for r in triage.unenriched(rows, done).collect()} == {"c", "e"}


def test_current_state_and_notifications(spark):
    scores = spark.createDataFrame([alert(x, score=0.9 - i / 100) for i, x in enumerate("abcd")], ALERT)
    schema = """alert_id string, enriched_at timestamp, enrichment_path string, combined_confidence double,
                attack_technique string, fp_assessment string, if_llm_disagreement boolean, routing_decision string"""
    rows = [
        ("a", utc("2024-01-02T00:00:00"), "B", 0.5, "T1", "medium", False, "analyst_review"),
        ("a", utc("2024-01-03T00:00:00"), "B", 0.8, "T2", "low", False, "high_priority"),
        ("b", utc("2024-01-02T00:00:00"), "B", 0.9, "T1", "low", False, "high_priority"),
        ("c", utc("2024-01-02T00:00:00"), "B", None, "T1", "high", True, "analyst_review"),
    ]
    log = [("a", utc("2024-01-04T00:00:00"), "failed"), ("b", utc("2024-01-04T00:00:00"), "sent")]
    current = alerts.current_alerts(
        scores, spark.createDataFrame(rows, schema), spark.createDataFrame(log, "alert_id string, ts timestamp, status string")
    ).cache()
    state = {r["alert_id"]: r for r in current.collect()}
    assert state["a"]["triage"]["attack_technique"] == "T2" and not state["a"]["notified"]
    assert state["b"]["notified"] and not state["d"]["enriched"] and state["d"]["fused_routing"] is None
    pending = alerts.pending_notifications(current)
    assert [r["alert_id"] for r in pending.collect()] == ["a", "c"]
    message = alerts.payload(pending, "scores").filter("alert_id = 'a'").first()
    assert message["host"] == "H" and '"combined_confidence":0.8' in message["payload"] and '"alert":{' in message["payload"]
    outcome = spark.createDataFrame([("a", True), ("c", False)], "alert_id string, ok boolean")
    logged = alerts.notification_rows(pending, outcome, F.current_timestamp())
    assert {r["alert_id"]: r["status"] for r in logged.collect()} == {"a": "sent", "c": "failed"}
    assert tuple(alerts.notification_summary(pending, logged).first()) == (2, 1, 1, 0)
    queue = alerts.alert_queue(current, 0.88)
    assert [r["alert_id"] for r in queue.collect()] == ["a", "b", "c"]
    assert [r["alert_id"] for r in alerts.disagreement_queue(queue).collect()] == ["c"]
    retried = spark.createDataFrame([("a", "failed"), ("a", "sent"), ("x", "sent")], "alert_id string, status string")
    assert tuple(alerts.notification_summary(pending, retried).first()) == (2, 1, 0, 1)
    figures = alerts.key_figures(current).first()
    assert (figures["total_events"], figures["anomalies"], figures["enriched"]) == (4, 4, 3)
    assert alerts.key_figures(current.filter("false")).first()["anomaly_pct"] == 0.0


def test_newest_run_of_each_alert(spark):
    """Old runs scored the other way round, and one alert is only in the old run."""
    rows = [(f"a{k}", run, (0.5 + k / 100 if run == "r2" else 0.99 - k / 100, utc(f"2024-01-0{1 + (run == 'r2')}T00:00:00")))
            for k in range(40) for run in ("r1", "r2") if (k, run) != (3, "r2")]
    scores = spark.createDataFrame(rows, "alert_id string, run_id string, ml struct<anomaly_score: double, scored_at: timestamp>")
    newest = {r["alert_id"]: r["run_id"] for r in alerts.newest_scores(scores).collect()}
    assert len(newest) == 40 and newest["a3"] == "r1" and set(newest.values()) == {"r1", "r2"} and newest["a4"] == "r2"
    want = sorted([(0.96, "a3"), *((0.5 + k / 100, f"a{k}") for k in range(40) if k != 3)], reverse=True)
    for look_at in (1, 5, None):
        top = alerts.newest_top(scores, F.col("ml.anomaly_score") >= 0.6, 5, look_at).collect()
        assert [r["alert_id"] for r in top] == [a for _, a in want[:5]]
    everything = alerts.newest_top(scores, F.col("ml.anomaly_score") >= 0.6, 500, 3).count()
    assert everything == sum(round(x, 2) >= 0.6 for x, _ in want)
