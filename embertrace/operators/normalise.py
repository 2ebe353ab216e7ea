"""Raw records to the canonical event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embertrace import fixed_values as fv
from embertrace import schemas
from embertrace.functions.text import (
    base_name,
    event_category,
    first_usable,
    group_category,
    non_empty,
    string_or_list,
    strip,
)

_JSON = {"allowSingleQuotes": "false"}


def parse_objects(lines: DataFrame, text: Column, schema: str) -> DataFrame:
    """Add ``r``: the fields of a line that is exactly one JSON object, null otherwise.

    The line is read as the only element of a list, so text after the object makes it
    malformed.  The generator keeps the parse in one place: filters on its result are not
    pushed below it, which would parse every line twice.
    """
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<struct<{schema}>>", _JSON)
    parsed = lines.select("*", F.explode(F.array(listed)).alias("_objects"))
    return parsed.withColumn("r", F.when(F.size("_objects") == 1, F.get("_objects", F.lit(0)))).drop("_objects")


def windows_events(lines: DataFrame) -> DataFrame:
    """Raw Windows events (``source_dataset, member, line_no, line``) to canonical events.

    Blank and malformed lines are dropped.  A line whose event id is not a whole number
    is kept with event id 0 and the cause in ``_bad_reason``.
    """
    r = lambda name: F.col(f"r.`{name}`")
    code = F.coalesce(strip(r("EventID")), F.lit("0")).try_cast("bigint")
    channel = F.coalesce(r("Channel"), F.lit(""))
    picked = first_usable(r("AccountName"), r("SubjectUserName"), r("TargetUserName"), r("User"))
    parsed = (
        parse_objects(lines, F.col("line"), schemas.RAW_WINDOWS_EVENT)
        .filter(F.col("r").isNotNull())
        .withColumn("code", F.coalesce(code, F.lit(0)))
    )
    ts = F.try_to_timestamp(first_usable(r("@timestamp"), r("EventTime")))
    return parsed.select(
        F.sha2(F.concat_ws("|", "source_dataset", "member", F.col("line_no").cast("string")), 256).alias("alert_id"),
        ts.alias("ts"),
        F.to_date(ts).alias("event_date"),
        F.struct(first_usable(r("Hostname"), r("host")).alias("name")).alias("host"),
        F.struct(F.nullif(picked, F.lit("-")).alias("name")).alias("user"),
        F.struct(
            base_name(
                first_usable(r("Image"), r("SourceImage"), r("NewProcessName"), r("ProcessName"))
            ).alias("name"),
            first_usable(r("CommandLine"), r("ParentCommandLine"), r("ScriptBlockText")).alias("command_line"),
            F.struct(base_name(first_usable(r("ParentImage"), r("ParentProcessName"))).alias("name")).alias("parent"),
        ).alias("process"),
        F.struct(
            event_category(channel, F.col("code")).alias("category"),
            F.col("code").cast("string").alias("id"),
            channel.alias("channel"),
        ).alias("event"),
        F.col("source_dataset"),
        string_or_list(r("tags")).alias("tags"),
        F.col("line").alias("_raw"),
        F.when(code.isNull(), F.lit("event id is not a whole number")).alias("_bad_reason"),
    )


def _agent_or(first: Column, second: Column, *fields: str) -> Column:
    """The first struct unless all of the named fields are absent."""
    empty = F.lit(True)
    for field in fields:
        empty = empty & first[field].isNull()
    return F.when(~empty, first).otherwise(second)


def parsed_alerts(lines: DataFrame) -> DataFrame:
    """Add ``r``, the parsed alert: parsed lines can be stored and then read for events and for rejects."""
    return parse_objects(lines, F.col("line"), schemas.RAW_ENDPOINT_ALERT)


def rejected_alerts(parsed: DataFrame) -> DataFrame:
    """``line, cause`` of the parsed lines that hold no alert; blank lines are none."""
    text = strip(F.col("line"))
    cause = (
        F.when(~F.startswith(text, F.lit("{")), F.lit("not an object"))
        .when(F.try_parse_json(text).isNull(), F.lit("malformed JSON"))
        .otherwise(F.lit("more than one object"))
    )
    return parsed.filter(F.col("r").isNull() & (text != "")).select("line", cause.alias("cause"))


def endpoint_alerts(lines: DataFrame, id_column: str | None = None) -> DataFrame:
    """Endpoint alerts (``line`` holds one JSON alert) to canonical events.

    ``lines`` may be parsed already (:func:`parsed_alerts`).

    ``agent`` and ``rule`` may sit at the top or below ``wazuh``.  The id is taken from
    ``id_column`` when the upstream store gives one, otherwise hashed from the text.
    """
    identity = F.col(id_column) if id_column else F.sha2(F.col("line"), 256)
    objects = lines if "r" in lines.columns else parsed_alerts(lines)
    parsed = objects.filter(F.col("r").isNotNull()).select(
        identity.alias("alert_id"),
        "r",
        _agent_or(F.col("r.agent"), F.col("r.wazuh.agent"), "id", "name").alias("agent"),
        _agent_or(
            F.col("r.rule"), F.col("r.wazuh.rule"), "id", "description", "level", "groups", "mitre"
        ).alias("rule"),
        F.col("r.data.win.eventdata").alias("win"),
    )
    win = lambda name: F.try_element_at(F.col("win"), F.lit(name))
    groups = string_or_list(F.col("rule.groups"))
    technique = non_empty(
        F.get(string_or_list(first_usable_list(F.col("rule.mitre.technique"), F.col("rule.mitre.id"))), F.lit(0))
    )
    rule_id = F.coalesce(F.col("rule.id"), F.lit(""))
    ts = F.try_to_timestamp(first_usable(F.col("r.`@timestamp`"), F.col("r.timestamp")))
    return parsed.select(
        "alert_id",
        ts.alias("ts"),
        F.to_date(ts).alias("event_date"),
        F.struct(first_usable(F.col("agent.name"), F.col("r.hostname")).alias("name")).alias("host"),
        F.struct(
            first_usable(win("subjectUserName"), win("targetUserName"), F.col("r.syscheck.uname_after")).alias("name")
        ).alias("user"),
        F.struct(
            base_name(first_usable(win("image"), win("Image"))).alias("name"),
            F.struct(base_name(first_usable(win("parentImage"), win("ParentImage"))).alias("name")).alias("parent"),
        ).alias("process"),
        F.struct(
            group_category(groups).alias("category"),
            rule_id.alias("id"),
            F.struct(technique.alias("technique")).alias("mitre"),
        ).alias("event"),
        F.lit("wazuh").alias("source_dataset"),
        F.struct(
            F.struct(
                rule_id.alias("id"),
                F.coalesce(F.col("rule.description"), F.lit("")).alias("description"),
                F.col("rule.level").try_cast("int").alias("level"),
                groups.alias("groups"),
            ).alias("rule"),
            F.struct(
                F.coalesce(F.col("agent.id"), F.lit("")).alias("id"),
                F.coalesce(F.col("agent.name"), F.lit("")).alias("name"),
            ).alias("agent"),
        ).alias("wazuh"),
    )


def first_usable_list(*values: Column) -> Column:
    """First text that is neither null, empty nor an empty JSON list."""
    return F.coalesce(*[F.when(~F.replace(v, F.lit(" "), F.lit("")).isin("", "[]"), v) for v in values])


def log_lines(lines: DataFrame, ingested_at: Column) -> DataFrame:
    """Text lines (``line``) to log events; blank lines are dropped.

    A JSON object gives its own fields, with the ingest time for a missing timestamp;
    any other text gives the first IPv4-shaped part and the type ``generic``.
    """
    line = strip(F.col("line"))
    trimmed = lines.withColumn("line", line).filter(F.col("line") != "")
    schema = "timestamp: string, source_ip: string, event_type: string, raw: string, anomaly_score: string"
    # Text that does not start like an object is not worth a parse.
    candidate = F.when(F.startswith("line", F.lit("{")), F.col("line"))
    parsed = parse_objects(trimmed, candidate, schema).withColumn("is_json", F.col("r").isNotNull())
    stamp = F.col("r.timestamp")
    # A stamp that is there but cannot be read stays null; a missing one gets the ingest time.
    read = F.when(stamp.isNull(), ingested_at).otherwise(F.try_to_timestamp(stamp))
    address = F.regexp_extract("line", fv.IPV4_SHAPE, 1)
    kept = [c for c in lines.columns if c != "line"]
    return parsed.select(
        *kept,
        F.when(F.col("is_json"), read).otherwise(ingested_at).alias("timestamp"),
        F.when(F.col("is_json"), F.col("r.source_ip")).otherwise(non_empty(address)).alias("source_ip"),
        F.when(F.col("is_json"), F.col("r.event_type")).otherwise(F.lit("generic")).alias("event_type"),
        F.when(F.col("is_json"), F.coalesce("r.raw", "line")).otherwise(F.col("line")).alias("raw"),
        F.when(F.col("is_json"), F.col("r.anomaly_score").try_cast("double")).alias("anomaly_score"),
    )


def union_sources(*events: DataFrame) -> DataFrame:
    """All event sources as one table; columns and struct fields one source lacks are null."""
    merged = events[0]
    for other in events[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged
