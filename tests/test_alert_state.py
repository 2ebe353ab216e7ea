"""The maintained alert state against the state recomputed from all rows, and the commits beneath it."""

import random
from datetime import timedelta

import pytest
from conftest import utc
from pyspark.sql import functions as F

from embertrace.operators.alerts import current_alerts
from embertrace.session import scratch_path
from embertrace.sources import alert_state, manifest
from embertrace.sources.alert_state import AlertState

SCORE = "alert_id string, host string, run_id string, ml struct<anomaly_score: double, routing_decision: string, scored_at: timestamp>"
TRIAGE = "alert_id string, enriched_at timestamp, fp_assessment string, routing_decision string, steps array<string>"
SENT = "alert_id string, ts timestamp, status string"
START = utc("2024-01-01T00:00:00")


def at(hours):
    return START + timedelta(hours=hours)


@pytest.fixture
def tables(spark):
    """A thousand alerts over five runs, with late, equal and repeated rows, triage before any score, failed messages."""
    rng = random.Random(3)
    scores, triage, sent = [], [], []
    for hour in range(5):
        for k in rng.sample(range(60), 25):
            scores.append((f"a{k}", "h", f"r{hour}", (round(rng.random(), 3), None, at(hour))))
        for k in rng.sample(range(70), 12):
            triage.append((f"a{k}", at(hour), rng.choice(["low", "high", None]), "tier-1", ["x"]))
            triage.append((f"a{k}", at(hour), "medium", "tier-1", None))
        for k in rng.sample(range(70), 12):
            sent.append((f"a{k}", at(hour), rng.choice(["sent", "failed"])))
    return scores, triage, sent


def frames(spark, tables, hours=None):
    pick = lambda rows, of: [r for r in rows if hours is None or of(r) in [at(h) for h in hours]]
    return (
        spark.createDataFrame(pick(tables[0], lambda r: r[3][2]), SCORE),
        spark.createDataFrame(pick(tables[1], lambda r: r[1]), TRIAGE),
        spark.createDataFrame(pick(tables[2], lambda r: r[1]), SENT),
    )


def rows(df):
    return sorted(map(str, df.select("alert_id", "ml", "run_id", "triage", "notified_at", "enriched", "notified", "fused_routing").collect()))


def test_any_order_of_deltas_gives_the_whole_state(spark, tables):
    want = rows(current_alerts(*frames(spark, tables)))
    state = AlertState(spark, scratch_path(spark, "state"), 4)
    for hours in ([2], [0, 4], [4], [1, 2, 3]):  # late and repeated ones
        state.apply(*frames(spark, tables, hours))
    assert rows(state.read()) == want
    refreshed = AlertState(spark, scratch_path(spark, "state"), 3)
    for hours in ([0], [0, 1], [0, 1, 2, 3], None):
        refreshed.refresh(*frames(spark, tables, hours))
    before = manifest.newest(spark, refreshed.root)
    assert rows(refreshed.read()) == want
    assert refreshed.refresh(*frames(spark, tables)).marks == before.marks
    assert rows(refreshed.read()) == want


def test_only_touched_buckets_are_written(spark, tables):
    state = AlertState(spark, scratch_path(spark, "state"), 16)
    first = state.apply(*frames(spark, tables))
    name = tables[0][0][0]
    one = spark.createDataFrame([(name, at(9), "low", "tier-2", ["x"])], TRIAGE)
    second = state.apply(triage=one)
    assert second.version == first.version + 1
    assert sum(second.folders[b] != first.folders.get(b) for b in second.folders) == 1
    got = state.read().filter(F.col("alert_id") == name).first()
    assert got["fused_routing"] == "tier-2" and state.read().count() == current_alerts(*frames(spark, tables)).count()
    assert state.apply(triage=one.limit(0)) == second
    assert manifest.forget(spark, state.root, keep=1) == 0 and state.read().count() > 0
    state.apply(*frames(spark, tables))
    assert manifest.forget(spark, state.root, keep=1) == 2
    others = F.col("alert_id") != name
    assert rows(state.read().filter(others)) == rows(current_alerts(*frames(spark, tables)).filter(others))


def test_a_large_bucket_is_merged_in_pieces(spark, tables, monkeypatch):
    want = rows(current_alerts(*frames(spark, tables)))
    monkeypatch.setattr(alert_state, "TASK_ROWS", 10, raising=False)
    state = AlertState(spark, scratch_path(spark, "state"), 2)
    for hours in ([2], [0, 1, 4], None):
        state.apply(*frames(spark, tables, hours))
    folders = manifest.newest(spark, state.root).folders
    files = [spark.read.parquet(folder).inputFiles() for folder in folders.values()]
    assert len(files) == 2 and min(map(len, files)) >= 5
    parts = state.read().select("alert_id", F.col("_metadata.file_path").alias("file")).groupBy("file").count().collect()
    assert max(r["count"] for r in parts) <= 30
    assert rows(state.read()) == want


def test_a_writer_that_dies_or_comes_second_changes_nothing(spark, tables, monkeypatch):
    state = AlertState(spark, scratch_path(spark, "state"), 4)
    state.apply(*frames(spark, tables, [0]))
    before = rows(state.read())

    def dies(*args, **kwargs):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(manifest, "commit", dies)
        with pytest.raises(RuntimeError):
            state.apply(*frames(spark, tables, [1]))
    assert rows(state.read()) == before
    head = manifest.newest(spark, state.root)
    state.apply(*frames(spark, tables, [1]))
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, state.root, head, {}, {}, head.schema)
    # a commit file that was cut off does not count, and its number is not used again
    newest = manifest.newest(spark, state.root)
    spark.createDataFrame([("{\"version\": 3, \"fold",)], "value string").coalesce(1).write.text(f"{state.root}/cut")
    fs, folder = manifest._open(spark, f"{state.root}/cut")
    part = next(f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part"))
    _, target = manifest._open(spark, f"{state.root}/_commits/{newest.version + 1:010d}.json")
    fs.rename(part, target)
    assert manifest.newest(spark, state.root) == newest
    assert state.apply(*frames(spark, tables, [2])).version == newest.version + 2


def test_state_of_nothing(spark, tables):
    state = AlertState(spark, scratch_path(spark, "state"), 4)
    with pytest.raises(ValueError):
        state.read()
    with pytest.raises(ValueError):
        state.apply(notifications=frames(spark, tables)[2])
    state.apply(*[f.limit(0) for f in frames(spark, tables)])
    assert state.read().count() == 0
    only_triage = frames(spark, tables)[1]
    state.apply(triage=only_triage)
    assert state.read().count() == 0
    state.apply(*frames(spark, tables))
    assert rows(state.read()) == rows(current_alerts(*frames(spark, tables)))
    assert state.read().filter(F.col("notified") != F.col("notified_at").isNotNull()).count() == 0
