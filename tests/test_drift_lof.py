from datetime import date

import numpy as np
import pandas as pd
import pytest
from conftest import EVENT_SCHEMA, event
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace.operators import day_state, drift, legacy
from embertrace.operators.features import feature_matrix
from embertrace.operators.lof import local_outlier_factor

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def windows(spark):
    random = np.random.default_rng(8)
    frame = lambda n, shift: pd.DataFrame(
        {"a": np.round(random.normal(shift, 1, n), 2), "b": random.integers(0, 4, n).astype(float), "c": np.ones(n)}
    )
    ref, cur = frame(900, 0), frame(600, 0.8)
    return ref, cur, spark.createDataFrame(ref), spark.createDataFrame(cur)


def test_distances(windows):
    ref, cur, r, c = windows
    running = drift.cumulative_windows(drift.window_histogram(r, c, NAMES))
    got = {row["feature"]: row for row in drift.drift_table(running).collect()}
    for name in NAMES:
        grid = np.unique(np.concatenate([ref[name], cur[name]]))
        f = np.searchsorted(np.sort(ref[name]), grid, side="right") / len(ref)
        g = np.searchsorted(np.sort(cur[name]), grid, side="right") / len(cur)
        w1 = np.sum(np.abs(f - g)[:-1] * np.diff(grid))
        assert got[name]["ks"] == pytest.approx(np.max(np.abs(f - g)))
        assert got[name]["w1"] == pytest.approx(w1, abs=1e-12)
        assert got[name]["w1_norm"] == pytest.approx(w1 / max(ref[name].std(ddof=0), 0.001), abs=1e-9)
        cuts = np.sort(ref[name])[[int(np.ceil(len(ref) * i / 10)) - 1 for i in range(1, 10)]]
        bins = lambda x: np.bincount(np.sum(x.to_numpy()[:, None] > cuts, axis=1), minlength=10) / len(x)
        p, q = bins(ref[name]), bins(cur[name])
        used = (p > 0) | (q > 0)
        p, q = np.maximum(p[used], 1e-4), np.maximum(q[used], 1e-4)
        assert got[name]["psi"] == pytest.approx(np.sum((q - p) * np.log(q / p)))
    assert got["a"]["drifted"] and not got["c"]["drifted"]


def test_gates(spark, windows):
    ref, cur, r, c = windows
    table = drift.drift_table(drift.cumulative_windows(drift.window_histogram(r, c, NAMES)))
    gates = lambda n, most=3: {
        g["name"]: g for g in drift.gate_rows(table, F.lit(900), F.lit(n), max_drifted=most).collect()
    }
    assert gates(630)["current_rows"]["limit"] == 630 and gates(630)["current_rows"]["passed"]
    assert not gates(629)["current_rows"]["passed"]
    assert not {g["name"]: g for g in drift.gate_rows(table, F.lit(0), F.lit(0)).collect()}["current_rows"]["passed"]
    assert gates(900)["drifted_features"]["passed"] and not gates(900, 0)["drifted_features"]["passed"]
    verdict = drift.gate_verdict(drift.gate_rows(table, F.lit(900), F.lit(629))).first()
    assert tuple(verdict) == (1, 1, False)


def test_empty_current_window(windows):
    _, _, r, c = windows
    running = drift.cumulative_windows(drift.window_histogram(r, c.filter("false"), NAMES))
    gates = {g["name"]: g for g in drift.gate_rows(drift.drift_table(running), F.lit(900), F.lit(0)).collect()}
    assert not gates["current_rows"]["passed"] and gates["current_rows"]["value"] == 0


def test_quality(spark, windows):
    ref, _, _, _ = windows
    holed = ref.copy()
    holed.loc[::9, "a"] = np.nan
    df = spark.createDataFrame(holed.astype(object).where(holed.notnull(), None), "a double, b double, c double")
    got = {r["feature"]: r for r in drift.quality_profile(df, NAMES).collect()}
    known = holed["a"].dropna()
    assert got["a"]["nulls"] == 100 and got["a"]["n"] == 800 and got["a"]["distinct_values"] == known.nunique()
    assert got["a"]["std_value"] == pytest.approx(known.std(ddof=0)) and got["a"]["mean_value"] == pytest.approx(known.mean())
    assert got["a"]["p50"] == np.sort(known)[399]
    assert got["c"]["is_constant"] and not got["b"]["is_constant"]
    assert got["b"]["most_common_share"] == pytest.approx(ref["b"].value_counts().iloc[0] / 900)


def brute_lof(points, scales, k):
    """LOF over all rows, ties at the k-th distance included."""
    rows = np.repeat(points[:, :2], points[:, 2].astype(int), axis=0)
    delta = [(rows[:, None, i] - rows[None, :, i]) / scales[i] for i in (0, 1)]
    d = np.sqrt(delta[0] ** 2 + delta[1] ** 2)
    np.fill_diagonal(d, np.inf)
    kd = np.sort(d, axis=1)[:, k - 1]
    near = d <= kd[:, None]
    reach = np.where(near, np.maximum(d, kd[None, :]), 0.0)
    lrd = 1 / (reach.sum(1) / near.sum(1) + 1e-10)
    lof = (near * lrd[None, :]).sum(1) / near.sum(1) / lrd
    return {(int(x), int(y)): v for (x, y), v in zip(rows, lof)}


@pytest.mark.parametrize("k, scales", [(5, (1.4, 31.0)), (20, (1.0, 1.0)), (3, (0.02, 50.0))])
def test_lof_against_all_pairs(spark, k, scales):
    random = np.random.default_rng(k)
    dense = {(int(x), int(y)) for x, y in zip(random.integers(0, 3, 150), random.integers(0, 90, 150))}
    grid = sorted(dense | {(40, 5), (41, 400), (2, 300)})
    weight = [30 if i % 50 == 7 else 1 + i % 2 for i in range(len(grid))]
    points = np.array([(x, y, w) for (x, y), w in zip(grid, weight)])
    df = spark.createDataFrame([tuple(int(v) for v in p) for p in points], "t bigint, s bigint, cnt bigint")
    got = {(r["t"], r["s"]): r["lof"] for r in local_outlier_factor(df, ["t", "s"], scales, "cnt", k=k).collect()}
    want = brute_lof(points, scales, k)
    assert set(got) == set(want)
    for p in want:
        assert got[p] == pytest.approx(want[p], rel=1e-6)


def test_lof_with_few_rows(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (5, 9, 1)], "t bigint, s bigint, cnt bigint")
    rows = local_outlier_factor(df, ["t", "s"], (1.0, 1.0), "cnt", k=20).collect()
    assert len(rows) == 3 and all(r["lof"] > 0 for r in rows)
    one = spark.createDataFrame([(0, 0, 4)], "t bigint, s bigint, cnt bigint")
    assert local_outlier_factor(one, ["t", "s"], (1.0, 1.0), "cnt").first()["lof"] == 1.0


@pytest.fixture(scope="module")
def log_rows(spark):
    rows = [(f"r{i}", ["login", "scan", "view", None][i % 4], f"10.0.0.{i % 12}") for i in range(240)]
    return spark.createDataFrame([*rows, ("odd", "zzz", "99.9.9.9")], "alert_id string, event_type string, source_ip string")


def test_codes(log_rows):
    got = {r["alert_id"]: r for r in legacy.categorical_codes(log_rows).collect()}
    types = sorted(["login", "scan", "view", "zzz"])
    ips = sorted({f"10.0.0.{i}" for i in range(12)} | {"99.9.9.9"})
    for r in log_rows.collect():
        assert got[r["alert_id"]]["event_type_code"] == (-1 if r["event_type"] is None else types.index(r["event_type"]))
        assert got[r["alert_id"]]["source_ip_code"] == ips.index(r["source_ip"])


@pytest.mark.parametrize("method", ["isolation_forest", "lof"])
def test_legacy_scores(log_rows, method):
    rows = {r["alert_id"]: r["anomaly_score"] for r in legacy.legacy_scores(log_rows, method, k=10).collect()}
    assert len(rows) == 241
    if method == "isolation_forest":
        assert min(rows.values()) == pytest.approx(0.0, abs=1e-6) and max(rows.values()) == pytest.approx(1.0)
    assert rows["odd"] == max(rows.values())


def test_legacy_edges(log_rows):
    assert legacy.legacy_scores(log_rows.filter("false")).count() == 0
    with pytest.raises(ValueError):
        legacy.legacy_scores(log_rows, "other")


def test_windows_of_days_are_the_windows_of_events(spark, tmp_path):
    """Missing keys, events without a time, late and repeated batches, windows of some days, empty windows."""
    rows = []
    for k in range(400):
        stamp = f"2024-01-{1 + k % 9:02d}T{k % 24:02d}:59:59" if k % 50 else None
        rows.append(event(f"e{k}", ts=stamp, proc=f"p{k % 7}" if k % 11 else None, parent=f"q{k % 5}" if k % 3 else "", user=f"u{k % 40}", category=["a", None][k % 2 == 0], cmd="wget x" if k % 4 else None))
    events = spark.createDataFrame(rows, EVENT_SCHEMA)
    path = str(tmp_path / "days")
    odd = F.crc32("alert_id") % 3
    for batch in (0, 2, 1, 2):
        day_state.add_days(events.filter(odd == batch), path, batch)
    counts = day_state.days(spark, path)
    for first, after in ((None, None), (date(2024, 1, 3), None), (None, date(2024, 1, 3)), (date(2024, 1, 2), date(2024, 1, 5)), (date(2025, 1, 1), None)):
        inside = events.filter("ts is not null")
        if first:
            inside = inside.filter(F.to_date("ts") >= F.lit(first))
        if after:
            inside = inside.filter(F.to_date("ts") < F.lit(after))
        assert day_state.window_rows(counts, first, after) == inside.count()
        features = feature_matrix(inside)
        long = features.select(*[F.col(f).cast("double").alias(f) for f in fv.FEATURES]).unpivot([], list(fv.FEATURES), "feature", "value")
        want = {(r["feature"], round(r["value"], 9)): r["count"] for r in long.groupBy("feature", "value").count().collect()}
        assert {(r["feature"], round(r["value"], 9)): r["cnt"] for r in day_state.window_values(counts, first, after).collect()} == want
