from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import utc
from pyspark.sql import functions as F

from embertrace import schemas
from embertrace.operators import coverage
from embertrace.operators.interval import block_sizes, event_blocks, span_blocks


def test_blocks_cover_the_span_exactly(spark):
    random = np.random.default_rng(1)
    span = 5_000
    starts = [int(x) for x in random.integers(-20_000, 20_000, 60)] + [0, 8, 64, 4096, -4096]
    df = spark.createDataFrame([(s,) for s in starts], "at bigint")
    sizes = block_sizes(span)
    for row in df.select("at", span_blocks("at", span).alias("blocks")).collect():
        covered = [
            t for b in row["blocks"] for t in range(b["block"] * sizes[b["level"]], (b["block"] + 1) * sizes[b["level"]])
        ]
        assert sorted(covered) == list(range(row["at"], row["at"] + span + 1))
        assert len(row["blocks"]) <= 14 * len(sizes)
    for row in df.select("at", event_blocks("at", span).alias("blocks")).collect():
        assert [(b["level"], b["block"]) for b in row["blocks"]] == [(i, row["at"] // s) for i, s in enumerate(sizes)]


def link(id, status=2, host="VICTIM", paw="abc", finish="2024-01-01T00:00:00Z", create=None, ability=("T1082", "look")):
    return (id, status, host, paw, finish, create, ability)


def steps_of(spark, *links, poll=None):
    df = spark.createDataFrame(list(links), schemas.EXEC_LINK)
    return {r["link_id"]: r for r in coverage.executed_steps(df).collect()}


def test_step_fields(spark):
    got = steps_of(
        spark,
        link("a"),
        link("b", ability=("", "dump")),
        link("c", ability=(None, None)),
        link("d", ability=None),
        link("e", host=None),
        link("f", host="", paw=""),
        link("g", finish="", create="2024-01-02T03:04:05Z"),
        link("h", finish="garbage", create="2024-01-02T03:04:05Z"),
        link("i", finish=None),
        link("j", status=1),
        link("k", status=3),
        link("l", status=-3),
    )
    assert set(got) == {"a", "b", "c", "d", "e", "f", "g", "k"}
    assert got["a"]["technique_id"] == "T1082" and got["a"]["host"] == "victim"
    assert got["b"]["technique_id"] == "unknown:dump"
    assert got["c"]["technique_id"] == "unknown:c" and got["c"]["ability_name"] == "(unknown)"
    assert got["d"]["technique_id"] == "unknown:d"
    assert got["e"]["host"] == "abc" and got["f"]["host"] == "unknown"
    assert got["g"]["executed_at"].isoformat() == "2024-01-02T03:04:05"


def test_each_link_once(spark):
    rows = [(*link("a"), 2), (*link("a", status=3, finish="2024-01-01T00:05:00Z"), 3), (*link("a", status=0), 1)]
    df = spark.createDataFrame(rows, schemas.EXEC_LINK + ", poll int")
    row = coverage.executed_steps(df, F.col("poll")).collect()
    assert len(row) == 1 and row[0]["status"] == 2


@pytest.fixture(scope="module")
def crowded(spark):
    """Most events and steps fall on one host within a few seconds, many at the same instant."""
    random = np.random.default_rng(2)
    start = utc("2024-03-01T00:00:00")

    def instants(n, spread):
        micros = np.where(random.random(n) < 0.5, random.integers(0, 5_000_000, n), random.integers(0, spread, n))
        return [start + timedelta(microseconds=int(m) // 500 * 500) for m in micros]

    def hosts(n):
        return list(np.where(random.random(n) < 0.6, "hot", random.choice(["x", "y", "z"], n)))

    events = pd.DataFrame(
        {
            "host": hosts(3000),
            "event_ts": instants(3000, 900_000_000),
            "alert_id": [f"e{i:05d}" for i in range(3000)],
            "score": np.round(random.uniform(0.5, 1, 3000), 2),
            "percentile": np.round(random.uniform(0, 100, 3000), 2),
        }
    )
    steps = pd.DataFrame(
        {
            "link_id": [f"s{i:03d}" for i in range(200)],
            "technique_id": [f"T{i % 9}" for i in range(200)],
            "ability_name": [f"ability {i % 9}" for i in range(200)],
            "host": hosts(200),
            "executed_at": instants(200, 900_000_000),
        }
    )
    to_spark = lambda pdf: spark.createDataFrame(pdf)
    return steps, events, to_spark(steps), to_spark(events)


def expected(steps, events, window):
    pairs = steps.merge(events, on="host")
    late = (pairs["event_ts"] - pairs["executed_at"]).dt.total_seconds()
    hits = pairs[(late >= 0) & (late <= window)].copy()
    hits["latency"] = late
    return hits.sort_values(["link_id", "score", "event_ts", "alert_id"], ascending=[True, False, True, True])


@pytest.mark.parametrize("window", [90, 1])
def test_step_results_match_the_plain_join(crowded, window):
    steps, events, s, e = crowded
    hits = expected(steps, events, window)
    best = hits.groupby("link_id").first()
    count = hits.groupby("link_id").size()
    first = hits.groupby("link_id")["latency"].min()
    got = {r["link_id"]: r for r in coverage.step_results(s, e, window).collect()}
    assert len(got) == 200
    for link_id, row in got.items():
        assert row["detected"] == (link_id in count.index)
        assert row["all_detecting_events"] == count.get(link_id, 0)
        assert row["detecting_events"] == min(count.get(link_id, 0), 10)
        if row["detected"]:
            assert row["max_score"] == pytest.approx(best.loc[link_id, "score"])
            assert row["max_percentile"] == pytest.approx(best.loc[link_id, "percentile"])
            assert row["best_latency_s"] == pytest.approx(best.loc[link_id, "latency"], abs=0.051)
            assert row["first_latency_s"] == pytest.approx(first[link_id], abs=0.051)
        else:
            assert row["max_score"] == 0 and row["best_latency_s"] is None and row["max_percentile"] is None


def test_top_detections_match_the_plain_join(crowded):
    steps, events, s, e = crowded
    hits = expected(steps, events, 90).groupby("link_id").head(10)
    want = {(link, n + 1): a for link, part in hits.groupby("link_id") for n, a in enumerate(part["alert_id"])}
    got = {(r["link_id"], r["rank"]): r["alert_id"] for r in coverage.top_detections(s, e, 90).collect()}
    assert got == want


def test_scorecard_adds_up(crowded):
    _, _, s, e = crowded
    results = coverage.step_results(s, e, 1).cache()
    rows = results.collect()
    card = coverage.scorecard(results).first()
    hit = [r for r in rows if r["detected"]]
    assert card["techniques_executed"] == 200 and card["detected"] + card["missed"] == 200
    assert card["detected"] == len(hit) and card["detection_rate"] == round(len(hit) / 200, 4)
    missed = {r["technique_id"]: r["missed_steps"] for r in coverage.missed_techniques(results).collect()}
    assert sum(missed.values()) == card["missed"]
    split = {r["status"]: r["steps"] for r in coverage.detection_split(results).collect()}
    assert split == {"Detected": card["detected"], "Missed": card["missed"]}
    assert all(r["max_score"] is None for r in coverage.step_table(results).filter("not detected").collect())
    tactic = F.when(F.col("technique_id") < "T5", "Execution").otherwise("Discovery")
    for r in coverage.tactic_coverage(results, tactic).collect():
        assert r["gap"] == r["techniques"] - r["covered"]


def test_empty_scorecard(crowded):
    _, _, s, e = crowded
    card = coverage.scorecard(coverage.step_results(s.filter("false"), e)).first()
    assert (card["techniques_executed"], card["detection_rate"], card["avg_detection_latency_seconds"]) == (0, 0.0, None)


def test_anomalies_meet_hosts_in_any_case(spark):
    scored = spark.createDataFrame(
        [("e", utc("2024-01-01T00:00:30"), ("VICTIM",), (0.9, 99.0, True)), ("f", utc("2024-01-01T00:00:31"), ("VICTIM",), (0.2, 9.0, True))],
        "alert_id string, ts timestamp, host struct<name: string>,"
        " ml struct<anomaly_score: double, anomaly_percentile: double, is_anomaly: boolean>",
    )
    found = coverage.anomalous_events(scored, 0.5)
    steps = coverage.executed_steps(spark.createDataFrame([link("a", host="Victim")], schemas.EXEC_LINK))
    row = coverage.step_results(steps, found).first()
    assert row["detected"] and row["best_latency_s"] == 30.0 and row["all_detecting_events"] == 1
