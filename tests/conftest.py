from __future__ import annotations

import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from embertrace.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "embertrace-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


EVENT_SCHEMA = """
    alert_id string, ts timestamp, host struct<name: string>, user struct<name: string>,
    process struct<name: string, command_line: string, parent: struct<name: string>>,
    event struct<category: string, id: string, channel: string>, source_dataset string
"""

#: What an event of the fixtures is unless a test says otherwise.
PLAIN = {
    "proc": "compile.bin",
    "parent": "agent.bin",
    "cmd": None,
    "category": "process_creation",
    "event_id": "1",
    "channel": "Security",
    "user": "svc-ci",
    "host": "build-07",
    "ts": "2023-11-05T17:40:00",
}


def event(alert_id, **changes):
    """A row of EVENT_SCHEMA: a plain event with changes."""
    e = PLAIN | changes
    return (
        alert_id,
        utc(e["ts"]) if e["ts"] else None,
        (e["host"],),
        (e["user"],),
        (e["proc"], e["cmd"], (e["parent"],)),
        (e["category"], e["event_id"], e["channel"]),
        "lab",
    )


BLOB = "b3duIHRlc3QgYmxvYiBvZiBzb21lIGxlbmd0aCBmb3IgdGhpcyBwYWNrYWdl"


@pytest.fixture(scope="session")
def ten_events(spark):
    """Four equal builds, then one each of: encoded text, rare pair, other host, two without a process, a download."""
    odd = [
        {"proc": "pack.bin", "parent": "compile.bin", "cmd": f"pack --blob {BLOB}"},
        {"proc": "probe.bin", "parent": "mailer.bin", "user": "ops"},
        {"proc": "sync.bin", "parent": "store.bin", "category": "network_connection", "event_id": "3", "host": "edge-2"},
        {"proc": None, "parent": None, "category": "script_execution", "event_id": "4104", "channel": "Windows PowerShell"},
        {"proc": None, "parent": None, "category": "network_connection", "event_id": "3"},
        {"proc": "fetch.bin", "parent": "compile.bin", "cmd": "fetch -q; WGET http://mirror.example/x; run x"},
    ]
    rows = [event(str(k), **changes) for k, changes in enumerate([{}] * 4 + odd)]
    return spark.createDataFrame(rows, EVENT_SCHEMA).cache()
