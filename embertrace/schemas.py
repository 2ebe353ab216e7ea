"""Declared schemas of the tables this package reads and writes."""

from __future__ import annotations

EVENT = """
    alert_id string, ts timestamp, event_date date,
    host struct<name: string>,
    user struct<name: string>,
    process struct<name: string, command_line: string, parent: struct<name: string>>,
    event struct<category: string, id: string, channel: string, mitre: struct<technique: string>>,
    wazuh struct<rule: struct<id: string, description: string, level: int, groups: array<string>>,
                 agent: struct<id: string, name: string>>,
    source_dataset string, tags array<string>, _raw string
"""

SCORE_STRUCT = """
    struct<anomaly_score: double, anomaly_percentile: double, is_anomaly: boolean,
           routing_decision: string, model: string, scored_at: timestamp,
           top_features: array<struct<feature: string, z_score: double>>>
"""

# A row of the scores table: an event without its raw text, its score and the run that gave it.
SCORED_EVENT = EVENT.rstrip().removesuffix(", _raw string") + f", ml {SCORE_STRUCT}, run_id string"

TRIAGE = """
    alert_id string, enriched_at timestamp, enrichment_path string,
    attack_technique string, attack_tactic string, description string,
    fp_assessment string, fp_reasoning string, investigation_steps array<string>,
    combined_confidence double, llm_confidence double, if_llm_disagreement boolean,
    routing_decision string
"""

NOTIFICATION = """
    alert_id string, ts timestamp, routing_decision string, combined_confidence double, status string
"""

RUN_LEDGER = """
    run_id string, job_type string, started_at timestamp, completed_at timestamp,
    duration_seconds double, dry_run boolean, result string, errors array<string>
"""

EXEC_LINK = """
    id string, status int, host string, paw string, finish string, `create` string,
    ability struct<technique_id: string, name: string>
"""

LOG_EVENT = """
    timestamp timestamp, source_ip string, event_type string, raw string, anomaly_score double
"""

# Raw Windows event: every scalar is read as text, so a type clash cannot null a row.
RAW_WINDOWS_EVENT = """
    EventID: string, Channel: string, Image: string, SourceImage: string, NewProcessName: string,
    ProcessName: string, ParentImage: string, ParentProcessName: string, CommandLine: string,
    ParentCommandLine: string, ScriptBlockText: string, AccountName: string, SubjectUserName: string,
    TargetUserName: string, User: string, `@timestamp`: string, EventTime: string, Hostname: string,
    host: string, tags: string
"""

_AGENT = "struct<id: string, name: string>"
_RULE = (
    "struct<id: string, description: string, level: string, groups: string,"
    " mitre: struct<technique: string, id: string>>"
)

# Raw endpoint alert; fields that may be a string or a list are read as text.
RAW_ENDPOINT_ALERT = f"""
    `@timestamp`: string, timestamp: string, hostname: string,
    agent: {_AGENT}, rule: {_RULE},
    wazuh: struct<agent: {_AGENT}, rule: {_RULE}>,
    data: struct<win: struct<eventdata: map<string, string>>>,
    syscheck: struct<uname_after: string>
"""
