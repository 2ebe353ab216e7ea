import json
import random
from datetime import timedelta
from types import SimpleNamespace

import pandas as pd
from conftest import EVENT_SCHEMA, event, utc
from pyspark.sql import functions as F

from embertrace import schemas
from embertrace.operators.features import Frequencies
from embertrace.operators.coverage import step_results
from embertrace.plans.retrain import retrain, score_new
from embertrace.session import scratch_path
from embertrace.sources.tables import append
from embertrace.streaming.bridge import alert_events, bridge_batch, bridge_stream, log_events, run_available, text_stream
from embertrace.streaming.detections import detection_stream
from embertrace.streaming.monitor import StepMonitor, monitored_steps, stateful
from embertrace.streaming.notifier import notification_log, notify_batch, notify_stream
from embertrace.streaming.scoring import score_stream


def drain(rows, path, checkpoint):
    run_available(rows, path, checkpoint).awaitTermination()


def test_bridge_takes_each_file_once(spark, tmp_path):
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    write = lambda n, *lines: (tmp_path / f"alerts-{n}.json").write_text("\n".join(lines) + "\n")
    ok = lambda n: json.dumps({"@timestamp": f"2024-01-01T00:00:0{n}Z", "rule": {"id": n, "groups": ["logon"]}})
    run = lambda: drain(alert_events(text_stream(spark, str(tmp_path))), out, checkpoint)
    write(1, ok(1), "{bad", ok(2))
    run()
    run()
    assert spark.read.parquet(out).count() == 2
    write(2, ok(3))
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["event"]["id"] for r in rows) == ["1", "2", "3"]
    assert {r["event"]["category"] for r in rows} == {"authentication"}


def test_log_sweep(spark, tmp_path):
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    (tmp_path / "a.log").write_bytes(b"from 1.2.3.4\n\n\xff\xfe odd bytes\n")
    (tmp_path / "b.log").write_text('{"event_type": "login"}\n')
    (tmp_path / "c.txt").write_text("not a log\n")
    rows = log_events(text_stream(spark, str(tmp_path / "*.log")), F.lit(utc("2024-01-01T00:00:00")))
    drain(rows, out, checkpoint)
    got = spark.read.parquet(out).collect()
    assert sorted(r["event_type"] for r in got) == ["generic", "generic", "login"]
    assert {r["source_ip"] for r in got} == {None, "1.2.3.4"}


def test_score_stream_equals_batch(spark, ten_events):
    trained = retrain(ten_events, "streamed", trees=30)
    folder = scratch_path(spark, "in")
    fresh = spark.createDataFrame([event("n1", proc="new.exe"), event("n2", cmd="wget x")], EVENT_SCHEMA)
    fresh.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(fresh.schema).parquet(folder)
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    scored = lambda: drain(score_stream(stream, trained.model, trained.frequencies), out, checkpoint)
    scored()
    fresh.filter("alert_id = 'n1'").withColumn("alert_id", F.lit("n3")).coalesce(1).write.mode("append").parquet(folder)
    scored()
    got = {r["alert_id"]: r for r in spark.read.parquet(out).collect()}
    want = score_new(trained.model, fresh, baseline="training", frequencies=trained.frequencies)
    for r in want.collect():
        assert got[r["alert_id"]] == r
    assert got["n3"]["anomaly_score"] == got["n1"]["anomaly_score"] and len(got) == 3
    assert isinstance(trained.frequencies, Frequencies)


STEP = "link_id string, technique_id string, ability_name string, host string, executed_at timestamp, status int"
HIT = "host string, event_ts timestamp, alert_id string, score double, percentile double"


def test_detections_with_misses_across_a_restart(spark):
    start = utc("2024-01-01T00:00:00")
    at = lambda s: start + timedelta(seconds=s)
    step = lambda id, host, s: (id, "T1", "x", host, at(s), 2)
    hit = lambda id, host, s: (host, at(s), id, 0.9, 99.0)
    steps_in, hits_in = scratch_path(spark, "steps"), scratch_path(spark, "hits")
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")

    def feed(steps, hits):
        append(spark.createDataFrame(steps, STEP).coalesce(1), steps_in)
        append(spark.createDataFrame(hits, HIT).coalesce(1), hits_in)
        rows = detection_stream(
            spark.readStream.schema(STEP).parquet(steps_in), spark.readStream.schema(HIT).parquet(hits_in), 90, "1 minute"
        )
        drain(rows, out, checkpoint)
        return {(r["link_id"], r["alert_id"]) for r in spark.read.parquet(out).collect()}

    first = feed(
        [step("s1", "a", 0), step("s1", "a", 0), step("s2", "a", 10), step("s3", "b", 20)],
        [hit("e1", "a", 90), hit("e2", "a", 101), hit("e3", "c", 25)],
    )
    assert {("s1", "e1"), ("s2", "e1")} <= first and ("s1", "e2") not in first
    assert ("s3", None) not in first
    # Rows much later close the window of the third step, after a restart.
    later = feed([step("s9", "z", 4000)], [hit("e9", "y", 4000)])
    later |= feed([step("s10", "z", 8000)], [hit("e10", "y", 8000)])
    assert ("s3", None) in later and ("s1", None) not in later
    rows = [r for r in spark.read.parquet(out).collect() if r["link_id"] in ("s1", "s2", "s3")]
    assert sorted((r["link_id"], r["alert_id"]) for r in rows if r["alert_id"]) == [("s1", "e1"), ("s2", "e1")]



def test_monitor_reports_each_step_once_and_misses_at_the_end_of_their_window(spark):
    start = utc("2024-01-01T00:00:00")
    at = lambda s: start + timedelta(seconds=s)
    step = lambda id, host, s: (id, "T1", "x", host, at(s), 2)
    hit = lambda id, host, s, score=0.9: (host, at(s), id, score, None)
    steps_in, hits_in = scratch_path(spark, "steps"), scratch_path(spark, "hits")
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    fed = [], []

    def feed(steps, hits):
        for rows, kind, path, all_rows in ((steps, STEP, steps_in, fed[0]), (hits, HIT, hits_in, fed[1])):
            all_rows += rows
            append(spark.createDataFrame(rows, kind).coalesce(1), path)
        asked, found = spark.readStream.schema(STEP).parquet(steps_in), spark.readStream.schema(HIT).parquet(hits_in)
        with stateful(spark):
            run_available(monitored_steps(asked, found, 90, "1 minute", cell_seconds=600), out, checkpoint).awaitTermination()
        return {r["link_id"]: r for r in spark.read.parquet(out).collect()}

    # windows that cross a cell's end, equal scores, an end that counts, and a link that three polls report
    first = feed(
        [step("s1", "a", 0), step("s1", "a", 0), step("s2", "a", 10), step("s3", "b", 20), step("s4", "a", 590), step("s5", "c", 599)],
        [hit("e1", "a", 90), hit("e2", "a", 101, 0.7), hit("e3", "c", 25), hit("e4", "a", 610), hit("e5", "a", 680, 0.9), hit("e6", None, 5)],
    )
    assert "s3" in first and not first["s3"]["detected"] and "s4" not in first
    # the third poll comes with later steps, after a restart
    later = feed([step("s1", "a", 0), step("s6", "a", 600)], [hit("e7", "a", 689, 0.95), hit("e8", "c", 690)])
    assert "s6" not in later
    feed([step("s9", "z", 4000)], [hit("e9", "y", 4000)])
    got = feed([step("s10", "z", 8000)], [hit("e10", "y", 8000)])
    steps, hits = spark.createDataFrame(fed[0], STEP).dropDuplicates(["link_id"]), spark.createDataFrame(fed[1], HIT)
    want = {r["link_id"]: r for r in step_results(steps, hits).collect()}
    assert {k: got[k] for k in want if k != "s10"} == {k: want[k] for k in want if k != "s10"}
    assert spark.read.parquet(out).count() == len(got) == 7
    assert [k for k in sorted(got) if not got[k]["detected"]] == ["s3", "s5", "s9"]


def test_a_busy_host_lies_in_many_keys(spark):
    """Twenty thousand anomalies of one host, waiting for steps: no key holds more than a cell of them."""
    steps_in, hits_in = scratch_path(spark, "steps"), scratch_path(spark, "hits")
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "checkpoint")
    stamp = lambda seconds: F.timestamp_seconds(F.lit(1_700_000_000) + seconds)
    rows = spark.range(20_000).select(
        F.lit("busy").alias("host"), stamp(F.col("id")).alias("event_ts"), F.col("id").cast("string").alias("alert_id"),
        F.lit(0.8).alias("score"), F.lit(1.0).alias("percentile"),
    )
    append(rows.coalesce(1), hits_in)
    steps = spark.range(3).select(
        F.concat(F.lit("s"), "id").alias("link_id"), F.lit("T1").alias("technique_id"), F.lit("x").alias("ability_name"), F.lit("busy").alias("host"),
        stamp(F.col("id") * 7_000 + 100).alias("executed_at"), F.lit(2).alias("status"),
    )
    append(steps.coalesce(1), steps_in)
    asked, found = (spark.readStream.schema(f.schema).parquet(p) for f, p in ((steps, steps_in), (rows, hits_in)))
    with stateful(spark):
        run_available(monitored_steps(asked, found, late="20 hours", cell_seconds=600), out, checkpoint).awaitTermination()
    assert spark.read.parquet(out).count() == 0  # nothing is closed yet
    held = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "hits").load(checkpoint)
    per_key = [len(r["list_value"]) if "list_value" in held.columns else r["count"] for r in (held if "list_value" in held.columns else held.groupBy("key").count()).collect()]
    assert len(per_key) >= 33 and max(per_key) <= 700 and sum(per_key) >= 20_000


class Kept:
    """A state list in memory that counts how often it is read."""

    def __init__(self):
        self.rows, self.reads = [], 0

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.reads += 1
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []


def test_a_crowded_cell_is_read_once_per_batch():
    """Timers and reads of a cell do not grow with its steps, and its steps get what a plain search finds."""
    rng = random.Random(5)
    second = 1_000_000
    row = lambda step, at, **more: {"is_step": step, "micros": at, "link_id": None, "technique_id": "T1", "ability_name": None, "score": None, "percentile": None, "alert_id": None} | more
    steps = [row(True, rng.randrange(600) * second, link_id=f"s{n}") for n in range(400)]
    hits = [row(False, rng.randrange(150, 690) * second, alert_id=f"e{n}", score=rng.choice([0.7, 0.8, 0.9]), percentile=rng.choice([None, 1.0])) for n in range(900)]
    lists, timers = {}, []
    monitor = StepMonitor(90, 600)
    monitor.init(SimpleNamespace(getListState=lambda name, ddl: lists.setdefault(name, Kept()), registerTimer=timers.append))
    assert list(monitor.handleInputRows(("h", 0), iter([pd.DataFrame(steps + hits)]), None)) == []
    assert len(timers) == 2
    found = []
    for watermark in (300_000, 700_000):
        expired = sorted({t for t in timers if t <= watermark})
        timers[:] = [t for t in timers if t > watermark]
        for t in expired:
            now = SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
            found += monitor.handleExpiredTimer(("h", 0), now, SimpleNamespace(getExpiryTimeInMs=lambda: t))
    assert lists["hits"].reads == 2 and not lists["hits"].rows and not lists["steps"].rows
    assert [f["at"].max() + 90 * second < 300_000_000 for f in found] == [True, False]
    got = {r["link_id"]: r for f in found for r in f.astype(object).where(f.notna(), None).to_dict("records")}
    assert len(got) == sum(map(len, found)) == 400
    for s in steps:
        mine = [h for h in hits if s["micros"] <= h["micros"] <= s["micros"] + 90 * second]
        best = max(mine, key=lambda h: (h["score"], -h["micros"], h["alert_id"]), default=row(False, None))
        r = got[s["link_id"]]
        assert (r["n"], r["first_at"], r["alert_id"], r["best_at"], r["score"], r["percentile"]) == (
            len(mine), min((h["micros"] for h in mine), default=None), best["alert_id"], best["micros"], best["score"], best["percentile"]
        )


TRIAGED = "alert_id string, enriched_at timestamp, routing_decision string, combined_confidence double"


def test_messages_once_and_again_after_failure(spark):
    triage_in, log, checkpoint = scratch_path(spark, "triage"), scratch_path(spark, "log"), scratch_path(spark, "c")
    when = utc("2024-01-01T00:00:00")
    broken = {"c"}
    asked = []

    def deliver(messages):
        rows = [(r["alert_id"], r["attempt"]) for r in messages.collect()]
        asked.extend(rows)
        # what starts with x is not even tried
        return spark.createDataFrame([(a, a not in broken) for a, _ in rows if a[0] != "x"], "alert_id string, ok boolean")

    def triaged(*rows):
        append(spark.createDataFrame([(a, when + timedelta(hours=n), route, 0.9) for n, (a, route) in enumerate(rows)], TRIAGED).coalesce(1), triage_in)
        stream = spark.readStream.schema(TRIAGED).parquet(triage_in)
        notify_stream(stream, log, deliver, checkpoint).awaitTermination()
        return sorted((r["batch"], r["alert_id"], r["attempt"], r["status"]) for r in notification_log(spark, log).collect())

    assert notification_log(spark, log).count() == 0
    first = triaged(("a", "high_priority"), ("a", "analyst_review"), ("b", "auto-close"), ("c", "analyst_review"), ("x", "high_priority"))
    assert first == [(0, "a", 1, "sent"), (0, "c", 1, "failed")]
    assert notification_log(spark, log).filter("alert_id = 'a'").first()["routing_decision"] == "analyst_review"
    second = triaged(("a", "high_priority"), ("d", "high_priority"), ("b", "auto-close"))
    assert second == first + [(1, "c", 2, "failed"), (1, "d", 1, "sent")]
    broken.clear()
    assert triaged(("b", "auto-close")) == second + [(2, "c", 3, "sent")]
    # a batch that comes again finds its attempts in the log
    before = list(asked)
    again = spark.createDataFrame([("a", when, "high_priority", 0.9), ("d", when, "high_priority", 0.9)], TRIAGED)
    assert notify_batch(again, 1, log, deliver) == 0 and asked == before
    # one that never got to its log delivers what is due
    assert notify_batch(again, 7, log, deliver) == 0
    assert notify_batch(again.withColumn("alert_id", F.concat(F.lit("n"), "alert_id")), 8, log, deliver) == 2


def test_notifier_keeps_no_state(spark):
    """However many alerts went out, the stream itself holds nothing."""
    triage_in, log, checkpoint = scratch_path(spark, "triage"), scratch_path(spark, "log"), scratch_path(spark, "c")
    rows = spark.range(2000).select(F.col("id").cast("string").alias("alert_id"), F.current_timestamp().alias("enriched_at"), F.lit("high_priority").alias("routing_decision"), F.lit(0.5).alias("combined_confidence"))
    append(rows.coalesce(1), triage_in)
    stream = spark.readStream.schema(rows.schema).parquet(triage_in)
    started = notify_stream(stream, log, lambda m: m.select("alert_id", F.lit(True).alias("ok")), checkpoint)
    started.awaitTermination()
    assert started.lastProgress["stateOperators"] == [] and notification_log(spark, log).count() == 2000


def test_bridge_keeps_what_it_rejects(spark, tmp_path):
    folder, checkpoint = scratch_path(spark, "bridge"), scratch_path(spark, "checkpoint")
    ok = lambda n: json.dumps({"@timestamp": f"2024-01-01T00:00:0{n}Z", "rule": {"id": n, "groups": ["logon"]}})
    run = lambda: bridge_stream(text_stream(spark, str(tmp_path)), folder, checkpoint).awaitTermination()
    (tmp_path / "1.json").write_text("\n".join([ok(1), "{bad", "", "  ", "word", '["list"]', ok(2) + "}", '{"rule": {"id": 3}}']) + "\n")
    run()
    run()
    (tmp_path / "2.json").write_text(ok(4) + "\n")
    run()
    (tmp_path / "3.json").write_text("\n\n")
    run()
    events = spark.read.parquet(f"{folder}/events")
    assert sorted((r["batch"], r["event"]["id"]) for r in events.collect()) == [(0, "1"), (0, "3"), (1, "4")]
    rejected = {(r["batch"], r["line"], r["cause"]) for r in spark.read.parquet(f"{folder}/rejected").collect()}
    assert rejected == {
        (0, "{bad", "malformed JSON"), (0, "word", "not an object"), (0, '["list"]', "not an object"), (0, ok(2) + "}", "more than one object"),
    }
    records = {r["run_id"]: json.loads(r["result"]) for r in spark.read.schema(schemas.RUN_LEDGER).parquet(f"{folder}/run_ledger").collect()}
    assert [records[k]["indexed"] + records[k]["skipped"] for k in sorted(records)] == [6, 1, 0]
    assert sum(r["indexed"] for r in records.values()) == events.count() and sum(r["skipped"] for r in records.values()) == len(rejected)
    # a batch that comes again replaces its own rows
    lines = spark.createDataFrame([(ok(5),)], "line string")
    assert bridge_batch(lines, 1, folder) == {"indexed": 1, "skipped": 0}
    assert [r["event"]["id"] for r in spark.read.parquet(f"{folder}/events").filter("batch = 1").collect()] == ["5"]
