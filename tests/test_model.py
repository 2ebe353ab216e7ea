from datetime import timedelta

import numpy as np
import pytest
from conftest import EVENT_SCHEMA, event, utc
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace.operators import iforest
from embertrace.operators.features import Frequencies, feature_matrix
from embertrace.operators.model import Model, batch_scores, fit, rank_scores, raw_scores, run_metrics
from embertrace.plans import retrain as retrain_module
from embertrace.plans.retrain import (
    retrain, run_summary, score_new, since_last_run, store, store_unfinished, stored, stored_model, stored_snapshot, with_events,
)
from embertrace.session import cut, scratch_path
from embertrace.sources import manifest
from embertrace.sources.tables import conform


@pytest.fixture(scope="module")
def trained(ten_events):
    return retrain(ten_events, "ten", contamination=0.2)


def rows_of(df):
    return {r["alert_id"]: r for r in df.collect()}


def test_score_ranges(trained):
    rows = rows_of(trained.scores)
    assert len(rows) == 10
    assert all(0.0 <= r["anomaly_score"] <= 1.0 for r in rows.values())
    assert all(0.0 < r["anomaly_percentile"] <= 100.0 for r in rows.values())
    assert max(r["anomaly_score"] for r in rows.values()) == 1.0
    assert all(len(r["top_features"]) == 3 for r in rows.values())
    assert all(f["feature"] in fv.FEATURES for r in rows.values() for f in r["top_features"])


def test_flag_share_and_order(trained):
    rows = rows_of(trained.scores)
    assert sum(r["is_anomaly"] for r in rows.values()) == 2
    assert rows["9"]["anomaly_score"] > rows["0"]["anomaly_score"]
    assert {r["routing_decision"] for r in rows.values() if not r["is_anomaly"]} == {"auto-close"}
    for r in rows.values():
        if r["is_anomaly"]:
            assert r["routing_decision"] == ("tier-1" if r["anomaly_score"] >= 0.8 else "tier-2")


def test_saved_model_scores_the_same(spark, ten_events, trained):
    path = scratch_path(spark, "models")
    trained.model.save(spark, path, trained.frequencies)
    model = Model.load(spark, path, "ten")
    again = rows_of(batch_scores(model, rank_scores(raw_scores(trained.features, model.scaler, model.forest))))
    assert again == rows_of(trained.scores)
    frequencies = Model.load_frequencies(spark, path, "ten")
    fresh = rows_of(score_new(model, ten_events, baseline="training", frequencies=frequencies))
    for alert_id, row in rows_of(trained.scores).items():
        assert fresh[alert_id]["anomaly_score"] == row["anomaly_score"]
        assert fresh[alert_id]["is_anomaly"] == row["is_anomaly"]


def test_batch_of_one(spark, trained):
    one = spark.createDataFrame([event("solo")], EVENT_SCHEMA)
    row = score_new(trained.model, one).first()
    assert row["anomaly_score"] == 1.0 and row["anomaly_percentile"] == 100.0


def test_empty_batch_gives_zeros(trained, ten_events):
    scores = score_new(trained.model, ten_events.filter("false"), baseline="training", frequencies=trained.frequencies)
    assert run_summary(scores).first() == (0, 0)


def test_errors(spark, trained, ten_events):
    with pytest.raises(ValueError):
        fit(feature_matrix(ten_events.filter("false"), trained.frequencies), "none")
    with pytest.raises(ValueError):
        score_new(trained.model, ten_events, baseline="training")
    with pytest.raises(Exception):
        Model.load(spark, scratch_path(spark, "nowhere"), "ten")
    empty = conform(spark.createDataFrame([], "run_id string"), "run_id string, job_type string, dry_run boolean,"
                    " errors array<string>, completed_at timestamp")  # fmt: skip
    with pytest.raises(RuntimeError):
        since_last_run(empty)


@pytest.fixture(scope="module")
def cloud(spark):
    """Thirty thousand points around zero and five far away."""
    x = [((F.rand(i + 1) + F.rand(i + 11) + F.rand(i + 21) - 1.5) * 2).alias(f"x{i}") for i in range(3)]
    near = spark.range(30_000).select(F.concat(F.lit("n"), "id").alias("alert_id"), *x)
    far = spark.range(5).select(F.concat(F.lit("far"), "id").alias("alert_id"), *[F.lit(9.0 + i).alias(f"x{i}") for i in range(3)])
    return cut(near.unionByName(far))


def test_forest_sample_and_ranking(cloud):
    columns = ["x0", "x1", "x2"]
    sample, size = iforest.sample_for_trees(cloud, "alert_id", 30_005, 50, 7)
    per_tree = sample.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("alert_id").alias("d"))
    assert size == 256
    assert {(r["n"], r["d"]) for r in per_tree.collect()} == {(256, 256)} and per_tree.count() == 50
    slots, _ = iforest.fit_trees(cloud, columns, "alert_id", 30_005, trees=50, seed=7)
    forest = iforest.Forest.of(slots, columns, size)
    lowest = forest.score(cloud).orderBy("raw").limit(5).collect()
    assert {r["alert_id"][:3] for r in lowest} == {"far"}
    moved, _ = iforest.fit_trees(cloud.repartition(7), columns, "alert_id", 30_005, trees=50, seed=7)
    other = iforest.Forest.of(moved, columns, size)
    np.testing.assert_array_equal(forest.threshold, other.threshold)
    np.testing.assert_array_equal(forest.path, other.path)


def test_native_walk_scores_the_same(cloud):
    columns = ["x0", "x1", "x2"]
    slots, size = iforest.fit_trees(cloud, columns, "alert_id", 30_005, trees=20, seed=3)
    forest = iforest.Forest.of(slots, columns, size)
    some = cloud.filter("alert_id like '%7' or alert_id like 'far%'")
    want = {r["alert_id"]: r["raw"] for r in forest.score(some).collect()}
    walked = forest.walk(some)
    plan = walked._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got = {r["alert_id"]: r["raw"] for r in walked.collect()}
    assert walked.columns == [*some.columns, "raw"] and got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_native_walk_is_compiled(cloud):
    """Expressions inside lambdas are interpreted for each row, tree and level."""
    columns = ["x0", "x1", "x2"]
    slots, size = iforest.fit_trees(cloud, columns, "alert_id", 30_005, trees=20, seed=3)
    plan = iforest.Forest.of(slots, columns, size).walk(cloud)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "from_json" not in plan


def test_tree_paths_by_walking():
    """The fixed-length walk ends on the depth of an explicit walk through the splits."""
    random = np.random.default_rng(3)
    rows = random.normal(size=(64, 2))
    tree = iforest.grow_tree(rows, 1, 0, 6)
    f, at, path = (tree[c].to_numpy() for c in ("feature", "threshold", "path"))
    forest = iforest.Forest(("a", "b"), 64, f[None], at[None], path[None])
    raw = forest.raw_scores(rows)
    for row, score in zip(rows, raw):
        slot, depth, here = 0, 0, rows
        while np.isfinite(at[slot]):
            left = row[f[slot]] <= at[slot]
            here = here[(here[:, f[slot]] <= at[slot]) == left]
            slot, depth = 2 * slot + (1 if left else 2), depth + 1
            if slot >= len(at):
                break
        expected = depth + iforest.average_path(len(here))
        assert score == pytest.approx(-(2 ** (-expected / iforest.average_path(64))))


def test_training_grid_percentile(spark, cloud):
    """Percentiles read off the saved grid stay within a step of the exact ones."""
    rename = {f: F.lit(0.0) for f in fv.FEATURES}
    rename |= {fv.FEATURES[i]: F.col(f"x{i}") for i in range(3)}
    features = cut(cloud.select("alert_id", *[c.alias(f) for f, c in rename.items()]))
    model, ranked = fit(features, "grid", trees=40)
    exact = rows_of(batch_scores(model, ranked))
    from embertrace.operators.model import training_scores

    read = rows_of(training_scores(model, features))
    assert max(abs(exact[k]["anomaly_percentile"] - read[k]["anomaly_percentile"]) for k in exact) <= 0.11
    assert all(exact[k]["anomaly_score"] == read[k]["anomaly_score"] for k in exact)
    flagged = sum(r["is_anomaly"] for r in exact.values())
    assert abs(flagged - 0.05 * 30_005) <= 1


def test_metrics_and_rows(ten_events, trained):
    row = run_metrics(trained.scores).first()
    scores = [r["anomaly_score"] for r in trained.scores.collect()]
    assert (row["events_scored"], row["anomaly_count"], row["anomaly_rate"], row["top_score"]) == (10, 2, 0.2, 1.0)
    assert row["score_p95"] == pytest.approx(np.quantile(scores, 0.95))
    written = with_events(ten_events.withColumn("_raw", F.lit("{}")), trained.scores, F.lit("r1"), F.current_timestamp())
    assert written.count() == 10 and "_raw" not in written.columns and "scored_at" in written.schema["ml"].dataType.names


def test_stored_run(spark, ten_events, trained):
    root = scratch_path(spark, "run")
    start = utc("2024-01-02T03:04:05")
    with pytest.raises(LookupError):
        stored(spark, root, "scores")
    store(trained, ten_events, root, start, start + timedelta(seconds=9))
    result = store(trained, ten_events, root, start, start + timedelta(seconds=30))
    store_unfinished(spark, "broken", root, start, start + timedelta(days=1), ["no space"])
    store_unfinished(spark, "trial", root, start, start + timedelta(days=2), result={"events_scored": 10})
    assert result == {"events_scored": 10, "anomalies_found": 2, "written": 10}
    scores = stored(spark, root, "scores")
    assert {str(r["run_id"]) for r in scores.collect()} == {"ten"}
    assert scores.filter("ml.is_anomaly").count() == 2 and scores.columns[:3] == ["alert_id", "ts", "event_date"]
    assert "rule" in scores.schema["wazuh"].dataType.names  # declared, though these events have none
    assert stored(spark, root, "feature_snapshot").count() == 10
    model, frequencies = stored_model(spark, root, "ten")
    assert model.cut_off == trained.model.cut_off and frequencies.total == 10
    metrics = {r["key"]: r["value"] for r in stored(spark, root, "run_metrics", "ten").collect()}
    assert metrics["anomaly_count"] == "2" and metrics["n_estimators"] == "200"
    assert metrics["dataset"] == "lab" and metrics["event_count"] == "10" and float(metrics["score_threshold"]) == trained.model.cut_off
    assert stored(spark, root, "run_metrics").count() == len(metrics)
    runs = stored(spark, root, "run_ledger")
    assert {r["run_id"]: (r["dry_run"], list(r["errors"])) for r in runs.collect()} == {
        "ten": (False, []), "broken": (False, ["no space"]), "trial": (True, [])
    }
    assert stored_snapshot(spark, root).count() == 10
    boundary = since_last_run(runs)
    assert boundary == (start + timedelta(seconds=30)).replace(tzinfo=None)
    late = utc("2024-05-05T00:00:00")
    assert since_last_run(runs, late) == late
    with pytest.raises(LookupError):
        stored_model(spark, root, "broken")


def test_a_run_that_dies_is_not_seen(spark, ten_events, trained, monkeypatch):
    """Whatever part it dies after: readers go on seeing the run before, whole."""
    root = scratch_path(spark, "run")
    start = utc("2024-01-02T03:04:05")
    store(trained, ten_events, root, start, start + timedelta(seconds=9))
    before = manifest.newest(spark, root)

    def dies(*args, **kwargs):
        raise RuntimeError("lost")

    for name in ("append", "run_metrics", "run_row", "_publish"):
        with monkeypatch.context() as broken:
            broken.setattr(retrain_module, name, dies)
            with pytest.raises(RuntimeError):
                store(trained, ten_events.limit(3), root, start, start + timedelta(seconds=50))
        assert manifest.newest(spark, root) == before
    assert stored(spark, root, "scores").count() == 10 and stored(spark, root, "run_ledger").count() == 1
    # what died is cleared away, what is seen stays
    assert manifest.forget(spark, root, keep=1) >= 4
    assert stored_model(spark, root, "ten")[0].cut_off == trained.model.cut_off and stored_snapshot(spark, root).count() == 10


def test_runs_that_commit_together_are_both_kept(spark, ten_events, trained, monkeypatch):
    root = scratch_path(spark, "run")
    start = utc("2024-01-02T03:04:05")
    newest, raced = manifest.newest, []

    def stale(session, where):
        """The first look is followed by another run's commit."""
        found = newest(session, where)
        if not raced:
            raced.append(True)
            store_unfinished(spark, "other", root, start, start, ["x"])
        return found

    monkeypatch.setattr(manifest, "newest", stale)
    store_unfinished(spark, "mine", root, start, start, ["y"])
    assert {r["run_id"] for r in stored(spark, root, "run_ledger").collect()} == {"other", "mine"}


def test_frequencies_total(ten_events):
    assert Frequencies.count(ten_events).total == 10
