import math

import numpy as np
import pandas as pd
from conftest import BLOB, EVENT_SCHEMA, event
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace.operators.features import Frequencies, command_indicators, feature_matrix, frequency_tables, rarest_pairs
from embertrace.operators.scaling import Scaler, feature_power, top_features
from embertrace.operators.skew import TableSize, join_counts


def by_id(df):
    return {r["alert_id"]: r.asDict() for r in df.collect()}


def test_frequency_tables(ten_events):
    rows = {(r["kind"], r["key1"], r["key2"]): r["n"] for r in frequency_tables(ten_events).collect()}
    assert rows[("proc", "compile.bin", None)] == 4
    assert rows[("parent", "compile.bin", None)] == 2
    assert rows[("parent_child", "agent.bin", "compile.bin")] == 4
    assert rows[("user", "svc-ci", None)] == 9 and rows[("user", "ops", None)] == 1
    assert rows[("host_event", "edge-2", "network_connection")] == 1
    assert rows[("total", "", None)] == 10
    assert not [k for k in rows if k[0] in ("proc", "parent") and k[1] is None]


def test_feature_values(ten_events):
    rows = by_id(feature_matrix(ten_events))
    assert rows["4"]["cmd_has_encoding"] == 1 and rows["4"]["has_cmd"] == 1
    assert rows["4"]["cmd_len"] == len(f"pack --blob {BLOB}")
    assert rows["9"]["cmd_has_download"] == 1 and rows["9"]["cmd_has_encoding"] == 0
    assert rows["0"]["has_cmd"] == 0 and rows["0"]["cmd_len"] == 0
    assert rows["5"]["proc_rarity"] > rows["0"]["proc_rarity"]
    assert rows["0"]["proc_rarity"] == math.log1p(10 / 4)
    assert rows["7"]["proc_rarity"] == 0 and rows["7"]["parent_child_rarity"] == 0
    assert rows["0"]["event_category_rank"] == fv.CATEGORY_RANK["process_creation"]
    assert rows["0"]["channel_rank"] == fv.CHANNEL_RANK["Security"]
    assert rows["7"]["channel_rank"] == fv.CHANNEL_RANK["Windows PowerShell"] and rows["7"]["event_id"] == 4104
    assert rows["0"]["hour"] == 17


def test_matrix_shape(spark, ten_events):
    matrix = feature_matrix(ten_events)
    assert tuple(matrix.columns) == ("alert_id", *fv.FEATURES)
    assert matrix.count() == 10
    assert not matrix.toPandas().isnull().any().any()
    assert feature_matrix(ten_events.filter("false")).count() == 0


def test_odd_values_become_zero(spark):
    rows = [
        event("a", proc="", parent="", user="", host="", category="other", event_id="x1", channel="nope", ts=None),
        event("b", category=None, event_id=None, channel=None, cmd="  \u00a0 "),
    ]
    got = by_id(feature_matrix(spark.createDataFrame(rows, EVENT_SCHEMA)))
    assert all(got["a"][f] == 0 for f in fv.FEATURES)
    assert got["b"]["event_category_rank"] == 0 and got["b"]["event_id"] == 0 and got["b"]["has_cmd"] == 0
    assert got["b"]["host_event_rarity"] == 0


def test_unseen_key_is_rarest(spark, ten_events):
    saved = Frequencies.count(ten_events)
    fresh = spark.createDataFrame([event("n", proc="new.exe")], EVENT_SCHEMA)
    row = by_id(feature_matrix(fresh, saved))["n"]
    assert row["proc_rarity"] == math.log1p(10)
    assert row["parent_proc_rarity"] == math.log1p(10 / 4)


def test_command_indicators(spark):
    texts = {
        "short blob": "A" * 39,
        "blob": "x=" + "Ab9+/" * 8 + "==",
        "wget": "WGET http://x",
        "long s": "biT\u017fadmin",
        "dotless": "DownloadF\u0131le",
        "curl without dot": "curlxexe",
        "curl": "Curl.EXE -O",
        "long": "a b" * 3000,
    }
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    got = {r["name"]: r["c"] for r in df.select("name", command_indicators(F.col("text")).alias("c")).collect()}
    assert [got[n]["cmd_has_encoding"] for n in ("short blob", "blob", "long")] == [0, 1, 0]
    assert [got[n]["cmd_has_download"] for n in ("wget", "dotless", "curl without dot", "curl", "blob")] == [1, 1, 0, 1, 0]
    assert got["long"]["cmd_len"] == 4096
    # The long s stands for an s, so this is a listed word in another letter case.
    assert got["long s"]["cmd_has_download"] == 1


def test_all_join_ways_agree(spark):
    """One user and one process hold over a third of the rows; nulls hold another part."""
    n = 3000
    rows = [
        event(
            str(i),
            proc=None if i % 7 == 0 else "hot.exe" if i % 2 else f"p{i % 211}.exe",
            parent=None if i % 5 == 0 else f"q{i % 17}.exe",
            user="hot" if i % 3 else f"u{i}",
            host=f"h{i % 3}",
        )
        for i in range(n)
    ]
    events = spark.createDataFrame(rows, EVENT_SCHEMA)
    corpus = Frequencies.count(events)
    small = by_id(feature_matrix(events, corpus))
    split = by_id(feature_matrix(events, corpus, broadcast_rows=0, heavy_keys=20))
    shuffled = by_id(feature_matrix(events, corpus, broadcast_rows=0, heavy_keys=1))
    assert len(small) == n and small == split == shuffled


def test_split_join_keeps_hot_rows_out_of_the_shuffle(spark):
    left = spark.range(2000).select(
        F.col("id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key")
    )
    counts = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    joined = join_counts(
        left, counts, ["key"], "n", size=TableSize(1001, 0), total=2000, spread_by=F.col("id"), broadcast_rows=0, heavy_keys=4
    )
    got = {r["key"]: r["n"] for r in joined.collect()}
    assert got["hot"] == 1000 and got["k1"] == 1 and joined.count() == 2000


def test_rarest_pairs(ten_events):
    rows = rarest_pairs(ten_events, limit=3).collect()
    assert [r["n"] for r in rows] == [1, 1, 1]
    assert [(r["parent"], r["proc"]) for r in rows] == sorted((r["parent"], r["proc"]) for r in rows)


def test_scaler_and_top_features(ten_events):
    matrix = feature_matrix(ten_events).cache()
    pdf = matrix.toPandas().set_index("alert_id")
    scaler = Scaler.fit(matrix)
    std = pdf.std(ddof=0).replace(0, 1.0)
    expected = (pdf - pdf.mean()) / std
    z = scaler.z_scores(matrix)
    got = z.toPandas().set_index("alert_id")[list(fv.FEATURES)].loc[expected.index]
    np.testing.assert_allclose(got, expected, atol=1e-12)
    tops = {r["alert_id"]: r["t"] for r in z.select("alert_id", top_features().alias("t")).collect()}
    for alert_id, row in expected.iterrows():
        order = sorted(range(13), key=lambda i: (-abs(got.loc[alert_id].iloc[i]), -i))[:3]
        assert [f["feature"] for f in tops[alert_id]] == [fv.FEATURES[i] for i in order]
    power = pd.Series({r["feature"]: r["mean_abs_z"] for r in feature_power(z).collect()})
    np.testing.assert_allclose(power[list(fv.FEATURES)], expected.abs().mean()[list(fv.FEATURES)], atol=1e-12)
