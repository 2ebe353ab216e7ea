import json
import zipfile
from datetime import datetime, timedelta

import pytest
from conftest import utc
from pyspark.sql import functions as F

from embertrace import schemas, session
from embertrace.operators import ledger, metrics, normalise
from embertrace.plans import catalog, telemetry
from embertrace.session import scratch_path, setting
from embertrace.sources import archives, scans, tables


@pytest.fixture()
def zips(tmp_path):
    good = {"EventID": 4688, "Channel": "Security", "NewProcessName": "C:\\A\\Net.EXE", "@timestamp": "2020-09-21T02:00:00Z",
            "Hostname": "WS1", "AccountName": "-", "SubjectUserName": "bob", "tags": ["t"]}
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        lines = [json.dumps(good), "", "  ", "{broken", "[1]", '{"EventID": "x"}', json.dumps(good) + "}", "{}"]
        z.writestr("a.json", "\n".join(lines))
        z.writestr("notes.txt", json.dumps(good))
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("dir/b.json", b'{"EventID": 1, "Channel": "Sysmon", "Image": "\xff\xfe.exe", "User": "eve"}\n')
    return tmp_path


def test_archives(spark, zips):
    lines = archives.zip_lines(spark, str(zips))
    assert {(r["source_dataset"], r["member"]) for r in lines.collect()} == {("one", "a.json"), ("two", "dir/b.json")}
    events = normalise.windows_events(lines).cache()
    rows = {(r["source_dataset"], r["event"]["id"], r["_bad_reason"] is None): r for r in events.collect()}
    assert set(rows) == {("one", "4688", True), ("one", "0", False), ("one", "0", True), ("two", "1", True)}
    net = rows[("one", "4688", True)]
    assert net["process"]["name"] == "net.exe" and net["event"]["category"] == "process_creation"
    assert net["user"]["name"] is None and net["host"]["name"] == "WS1" and net["tags"] == ["t"]
    assert net["ts"] == datetime(2020, 9, 21, 2) and json.loads(net["_raw"])["EventID"] == 4688
    bad = rows[("two", "1", True)]
    assert bad["process"]["name"] == "\ufffd\ufffd.exe" and bad["user"]["name"] == "eve"
    assert events.select("alert_id").distinct().count() == 4
    again = normalise.windows_events(archives.zip_lines(spark, str(zips / "one.zip")))
    assert {r["alert_id"] for r in again.collect()} <= {r["alert_id"] for r in events.collect()}
    totals = {
        (r["source_dataset"], r["is_total"]): r["events"] for r in metrics.counts_with_total(events, "source_dataset").collect()
    }
    assert totals == {("one", False): 3, ("two", False): 1, (None, True): 4}
    nameless = spark.createDataFrame([("x",), (None,), ("x",)], "k string")
    assert {tuple(r) for r in metrics.counts_with_total(nameless, "k").collect()} == {("x", False, 2), (None, False, 1), (None, True, 3)}


def test_an_archive_is_read_by_members(spark, tmp_path):
    """Two hundred members of one archive, stored and packed in several ways, are read by fifty tasks and more."""
    ways = [zipfile.ZIP_DEFLATED, zipfile.ZIP_STORED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]
    want = set()
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for k in range(200):
            lines = [json.dumps({"EventID": k, "n": n, "t": "é" * (n % 7)}) for n in range(k % 50)]
            z.writestr(zipfile.ZipInfo(f"part {k}/é-{k}.json"), "\n\n".join(lines) + "\r\n" * (k % 2), compress_type=ways[k % 4])
            z.writestr(f"part {k}/readme.txt", "no")
            want |= {("many", f"part {k}/é-{k}.json", 2 * n, line) for n, line in enumerate(lines)}
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    lines = archives.zip_lines(spark, str(tmp_path))
    got = lines.withColumn("task", F.spark_partition_id()).collect()
    assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    assert len({r["task"] for r in got}) >= 25
    members = archives.zip_members(spark, str(tmp_path)).repartition(archives.zip_lines(spark, str(tmp_path)).rdd.getNumPartitions(), "path", "at")
    assert members.select(F.spark_partition_id()).distinct().count() >= 50
    whole = spark.read.format("binaryFile").load(str(tmp_path / "many.zip")).select("path", "content").mapInPandas(archives._unzip, archives._SCHEMA)
    assert {tuple(r) for r in whole.collect()} == want
    assert archives.zip_lines(spark, str(tmp_path / "none.zip")).count() == 0
    with open(tmp_path / "bad.zip", "wb") as f:
        f.write((tmp_path / "many.zip").read_bytes()[:2000])
    with pytest.raises(Exception):
        archives.zip_lines(spark, str(tmp_path / "bad.zip")).count()


def test_lines_keep_their_place_however_files_are_split(spark, tmp_path):
    texts = {
        "a": "".join(json.dumps({"EventID": n % 9, "x": "é" * (n % 40)}) + "\n" * (1 + n % 3) for n in range(4000)),
        "b": '{"EventID": 1}\r\n{"EventID": 1}\n  \n{"EventID": 1}',
        "long": '{"EventID": 2}\n' + '"' + "x" * 300_000 + '"\n{"EventID": 3}\n',
        "empty": "",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_bytes(text.encode())
    want = set()
    for name, text in texts.items():
        at = 0
        for line in text.encode().split(b"\n"):
            if line.strip(b"\r ").strip():
                want.add((name, at, line.decode().rstrip("\r")))
            at += len(line) + 1

    def read(*names):
        rows = archives.json_lines(spark, *[str(tmp_path / f"{n}.json") for n in names]).collect()
        assert len(rows) == len({(r["member"], r["line_no"]) for r in rows})
        return {(r["source_dataset"], r["line_no"], r["line"]) for r in rows}

    alone = read("a")
    assert alone == {w for w in want if w[0] == "a"} and read(*texts) == want
    for size in ("10000", "65536"):
        with setting(spark, "spark.sql.files.maxPartitionBytes", size):
            assert read(*texts) == want
    # a file that has grown keeps the places it had
    with open(tmp_path / "a.json", "a") as f:
        f.write('{"EventID": 5}\n' * 2)
    assert alone < read("a")


def test_small_splits_share_tasks(spark, tmp_path):
    """A hundred splits are read by as many tasks as their bytes ask for, and not before rows are asked for."""
    (tmp_path / "a.json").write_text("".join(f'{{"EventID": {n}}}\n' * (1 + n % 2) for n in range(40_000)))
    plain = archives.json_lines(spark, str(tmp_path)).select("line_no", "line")
    with setting(spark, "spark.sql.files.maxPartitionBytes", "10000"):
        splits = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_block_start")).distinct().count()
        spark.sparkContext.setJobGroup("lines", "lines")
        lines = archives.json_lines(spark, str(tmp_path))
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lines")
        spark.sparkContext.setJobGroup("rows", "rows")
        assert splits >= 100 and lines.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert lines.count() == 60_000 and lines.select("line_no", "line").exceptAll(plain).isEmpty()
    assert plain.count() == 60_000


def test_unpacked_lines(spark, tmp_path):
    (tmp_path / "rec.json").write_text('{"EventID": 1}\n\n{"EventID": 1}\n')
    events = normalise.windows_events(archives.json_lines(spark, str(tmp_path / "rec.json")))
    rows = events.collect()
    assert [r["source_dataset"] for r in rows] == ["rec", "rec"] and len({r["alert_id"] for r in rows}) == 2


def test_log_lines(spark, tmp_path):
    lines = [
        '{"timestamp": "2024-01-01T00:00:00Z", "source_ip": "1.1.1.1", "event_type": "login", "anomaly_score": 0.5}',
        '{"event_type": "x"}', "sshd from 10.20.30.40 and 1.2.3.4", "{broken 9.9.9.9", "   ", "nothing", '{"timestamp": "bad"}',
    ]
    (tmp_path / "a.log").write_text("\n".join(lines))
    now = utc("2024-05-05T00:00:00")
    rows = normalise.log_lines(archives.text_lines(spark, str(tmp_path / "*.log")), F.lit(now)).collect()
    got = [(r["timestamp"], r["source_ip"], r["event_type"], r["anomaly_score"]) for r in rows]
    at = datetime(2024, 5, 5)
    assert got == [
        (datetime(2024, 1, 1), "1.1.1.1", "login", 0.5), (at, None, "x", None), (at, "10.20.30.40", "generic", None),
        (at, "9.9.9.9", "generic", None), (at, None, "generic", None), (None, None, None, None),
    ]
    assert rows[2]["raw"] == lines[2]


def test_endpoint_alerts(spark):
    nested = {"wazuh": {"agent": {"id": "7", "name": "A"}, "rule": {"id": 5, "groups": "syscheck", "level": 3, "mitre": {"id": "T1"}}},
              "timestamp": "2024-01-01T00:00:00Z", "syscheck": {"uname_after": "root"}, "agent": {}}
    flat = {"agent": {"name": ""}, "hostname": "hn", "rule": {"groups": ["a", "Logon"], "mitre": {"technique": ["T2", "T3"]}},
            "data": {"win": {"eventdata": {"Image": "C:\\x.exe", "image": "", "targetUserName": "t", "n": 5}}}}
    lines = spark.createDataFrame([("n", json.dumps(nested)), ("f", json.dumps(flat)), ("b", "{oops")], "id string, line string")
    rows = {r["alert_id"]: r for r in normalise.endpoint_alerts(lines, "id").collect()}
    assert set(rows) == {"n", "f"}
    n, f = rows["n"], rows["f"]
    assert n["host"]["name"] == "A" and n["user"]["name"] == "root" and n["event"]["category"] == "file_create"
    assert n["event"]["mitre"]["technique"] == "T1" and n["wazuh"]["rule"]["level"] == 3 and n["wazuh"]["rule"]["groups"] == ["syscheck"]
    assert f["host"]["name"] == "hn" and f["user"]["name"] == "t" and f["process"]["name"] == "x.exe"
    assert f["event"]["mitre"]["technique"] == "T2" and f["event"]["category"] == "authentication" and f["event"]["id"] == ""
    both = normalise.union_sources(
        normalise.windows_events(spark.createDataFrame([("s", "m", 1, '{"EventID": 3}')], "source_dataset string, member string, line_no bigint, line string")),
        normalise.endpoint_alerts(lines, "id"),
    )
    assert both.count() == 3 and {"tags", "wazuh", "_raw"} <= set(both.columns)


def test_alert_scan(spark, tmp_path):
    for day in (1, 2):
        line = json.dumps({"@timestamp": f"2024-01-0{day}T00:00:00Z", "rule": {"id": day}})
        (tmp_path / f"alerts-2024.01.0{day}.json").write_text(line + "\n")
    glob = str(tmp_path / "alerts-*.json")
    assert scans.alert_lines(spark, None, glob).count() == 2
    # The boundary itself is not new.
    assert scans.alert_lines(spark, utc("2024-01-01T00:00:00"), glob).count() == 1
    assert scans.alert_lines(spark, utc("2024-01-02T00:00:00"), glob).count() == 0
    assert scans.alert_lines(spark, None, str(tmp_path / "none-*.json")).count() == 0


def test_event_table(spark):
    rows = spark.createDataFrame(
        [(f"e{i}", utc("2024-01-01T00:00:00") + timedelta(hours=6 * i), ("h",), "raw") for i in range(12)],
        "alert_id string, ts timestamp, host struct<name: string>, _raw string",
    ).withColumn("event_date", F.to_date("ts"))
    path = scratch_path(spark, "events")
    events = tables.conform(rows, schemas.EVENT)
    assert tables.append_events(events, path) == 12
    stored = spark.read.parquet(path)
    assert set(stored.columns) == {f.split()[0] for f in ["alert_id", "ts", "event_date", "host", "user", "process", "event", "wazuh", "source_dataset", "tags", "_raw"]}
    fresh = scans.events_since(stored, utc("2024-01-03T00:00:00"))
    assert fresh.count() == 3 and "_raw" not in fresh.columns
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan.replace("\n", " ")
    assert scans.events_since(stored, None).count() == 12 and scans.all_events(stored, 5).count() == 5
    assert scans.events_last_days(stored, utc("2024-01-09T00:00:00")).count() == 7
    assert [r["alert_id"] for r in scans.recent_rows(stored, "ts", 2).collect()] == ["e11", "e10"]
    assert metrics.cursor(stored).first()["last_seen"] == datetime(2024, 1, 3, 18)


def test_create_if_absent(spark):
    tables.create_if_absent(spark, "scores_table", schemas.TRIAGE)
    tables.create_if_absent(spark, "scores_table", schemas.TRIAGE)
    assert spark.table("scores_table").count() == 0
    assert spark.table("scores_table").columns[0] == "alert_id"


def test_scorecard_same_day_replaced(spark):
    path = scratch_path(spark, "scorecards")
    card = lambda n: spark.createDataFrame([(n,)], "techniques_executed int")
    steps = lambda n: spark.range(n).select(F.col("id").cast("string").alias("link_id"))
    tables.write_scorecard(card(1), steps(1), path, "2024-01-01")
    tables.write_scorecard(card(2), steps(2), path, "2024-01-02")
    tables.write_scorecard(card(3), steps(3), path, "2024-01-02")
    stored = spark.read.parquet(f"{path}/summary")
    assert {(str(r["report_date"]), r["techniques_executed"]) for r in stored.collect()} == {("2024-01-01", 1), ("2024-01-02", 3)}
    assert scans.latest_scorecard(stored).first()["techniques_executed"] == 3
    assert spark.read.parquet(f"{path}/steps").count() == 4


def test_snapshots(spark):
    path = scratch_path(spark, "snapshots")
    for run, n in (("20240101_000000", 2), ("20240102_000000", 3)):
        tables.write_snapshot(spark.range(n), path, run)
    start = utc("2024-01-01T00:00:00")
    runs = ledger.run_row(spark, "retrain", start, start + timedelta(days=9), "{}", run_id="20240101_000000").unionByName(
        ledger.run_row(spark, "retrain", start, start + timedelta(days=8), "{}", run_id="20240102_000000")
    )
    assert scans.feature_snapshot(spark, path, ledger=runs).count() == 2  # finished last, though named first
    with pytest.raises(ValueError):
        scans.feature_snapshot(spark, path)
    assert scans.feature_snapshot(spark, path, "20240101_000000").count() == 2
    with pytest.raises(Exception):
        scans.feature_snapshot(spark, scratch_path(spark, "none")).count()


def test_notification_log(spark):
    path = scratch_path(spark, "log")
    row = spark.createDataFrame([("a", None, "high_priority", 0.9, "sent")], schemas.NOTIFICATION)
    assert tables.append_log(row, path) == 1 and tables.append_log(row, path) == 1
    assert spark.read.schema(schemas.NOTIFICATION).json(path).count() == 2


def run(job="retrain", done="2024-01-01T00:00:00", dry=False, errors=(), id=None):
    return {"run_id": id or done, "job_type": job, "completed_at": done, "dry_run": dry, "errors": list(errors), "result": "{}"}


@pytest.mark.parametrize(
    "records, expected",
    [
        ([], None),
        ([run(dry=True)], None),
        ([run(errors=["boom"])], None),
        ([run(done=None, id="x")], None),
        ([run(job="enrichment")], None),
        ([run(done="2024-01-01T00:00:00"), run(done="2024-01-03T00:00:00"), run(done="2024-01-09T00:00:00", dry=True)], datetime(2024, 1, 3)),
        ([run(done="2024-01-02T00:00:00"), "not json"], datetime(2024, 1, 2)),
    ],
)
def test_last_valid_run(spark, tmp_path, records, expected):
    for i, record in enumerate(records):
        (tmp_path / f"retrain_{i}.json").write_text(record if isinstance(record, str) else json.dumps(record))
    (tmp_path / "retrain_z.json").write_text("{}")
    row = ledger.last_valid_run(scans.run_records(spark, str(tmp_path / "*.json"))).first()
    assert (row and row["completed_at"]) == expected


def test_run_rows(spark):
    start = datetime(2024, 1, 2, 3, 4, 5)
    row = ledger.run_row(spark, "retrain", start, start + timedelta(seconds=7.256), '{"events_scored": 3}', dry_run=True).first()
    assert row["run_id"] == "20240102_030405" and row["duration_seconds"] == 7.26 and row["dry_run"] and row["errors"] == []
    path = scratch_path(spark, "ledger")
    for i in range(2):
        tables.append(ledger.run_row(spark, "retrain", start + timedelta(days=i), start + timedelta(days=i), "{}"), path)
    assert ledger.last_valid_run(spark.read.parquet(path)).first()["run_id"] == "20240103_030405"
    wide = spark.createDataFrame([(1, 0.5)], "events int, rate double")
    rows = ledger.metric_rows(F.lit("r"), "metric", wide).collect()
    assert [tuple(r) for r in rows] == [("r", "metric", "events", "1"), ("r", "metric", "rate", "0.5")]


def test_lines_of_one_day_are_written_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_LINES_A_TASK", 100)
    lines = spark.range(2000).select(F.lit("day1").alias("day"), F.col("id").alias("line_no"), F.col("id").cast("string").alias("value"))
    folder = scratch_path(spark, "lines")
    catalog._write_by_day(lines, 2000, folder)
    written = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    assert {r["value"] for r in written.collect()} == {str(n) for n in range(2000)}
    assert max(r["count"] for r in written.groupBy("file").count().collect()) <= 200


def test_lines_of_events_without_an_id_of_their_own_are_taken_in(spark):
    """Ten events of which three share an id and one has none: each is two lines, a bad one (k of 19) no event."""
    folder = scratch_path(spark, "tables")
    ids = F.when(F.col("id") < 9, F.when(F.col("id") < 3, F.lit(0)).otherwise(F.col("id")))
    rows = spark.range(10).select(
        ids.alias("event_id"), (F.col("id") * F.expr("interval 1 day") + F.lit("2024-01-07 00:00:00").cast("timestamp_ntz")).alias("ts"),
        F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
        F.format_string('{"k": %d}', F.when(F.col("id") == 5, 19).otherwise(F.col("id"))).alias("props"),
    )
    rows.write.parquet(f"{folder}/events.parquet")
    # the days are Sunday to Saturday, then Sunday to Tuesday; Monday to Thursday are taken in twice
    assert tuple(catalog.QUERIES["reingest_ids"](spark, folder).first()) == (18, 18, 12)


def test_events_of_one_file_go_to_many_tasks(spark, monkeypatch):
    """A scan is cut by bytes: a thousand events in a few kilobytes would be one task."""
    monkeypatch.setattr(session, "TASK_ROWS", 100, raising=False)
    folder = scratch_path(spark, "tables")
    rows = spark.range(1000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"),
        F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 3}').alias("props"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/events.parquet")
    events = telemetry.base_events(spark, folder)
    sizes = events.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in sizes) == events.select("event_id").distinct().count() == 1000
    assert len(sizes) == 10 and max(r["count"] for r in sizes) <= 110
