import pytest
from pyspark.sql import functions as F

from embertrace.functions import text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*columns).collect()]


def test_base_name(spark):
    paths = ["C:\\Windows\\System32\\CMD.exe", "d:/tools/Alt.EXE", "plain.exe", "c:\\dir\\", "", None, "a\\b/c.Exe"]
    got = values(spark, [(p,) for p in paths], "p string", text.base_name(F.col("p")))
    assert [g[0] for g in got] == ["cmd.exe", "alt.exe", "plain.exe", None, None, None, "c.exe"]


@pytest.mark.parametrize(
    "channel, code, expected",
    [
        ("Microsoft-Windows-Sysmon/Operational", 1, "process_creation"),
        ("Microsoft-Windows-SYSMON/Operational", 13, "registry_event"),
        ("Microsoft-Windows-Sysmon/Operational", 99, "sysmon_99"),
        ("Security", 4625, "authentication"),
        ("security", 4689, "process_creation"),
        ("Security", 5145, "network_share"),
        ("Security", 1102, "security_1102"),
        ("Windows PowerShell", 800, "script_execution"),
        ("Microsoft-Windows-WMI-Activity/Operational", 5857, "wmi_activity"),
        ("Sysmon and Security", 4625, "sysmon_4625"),
        ("Sysmon", 99_999_999_999, "sysmon_99999999999"),
        ("System", 1, "other"),
        (None, 1, "other"),
    ],
)
def test_event_category(spark, channel, code, expected):
    rows = values(spark, [(channel, code)], "c string, i bigint", text.event_category(F.col("c"), F.col("i")))
    assert rows == [(expected,)]


@pytest.mark.parametrize(
    "groups, category, tactic",
    [
        (["Windows", "Win_Logon"], "authentication", "Unknown"),
        (["sysmon_event1"], "process_creation", "Unknown"),
        (["firewall", "lateral_movement"], "network_connection", "Lateral Movement"),
        (["regscan", "Privilege"], "registry_event", "Privilege Escalation"),
        (["wscript", "execution"], "script_execution", "Execution"),
        (["syscheck"], "file_create", "Unknown"),
        (["wmi"], "wmi_activity", "Unknown"),
        (["defense_evasion"], "wazuh_alert", "Defense Evasion"),
        ([], "wazuh_alert", "Unknown"),
        (None, "wazuh_alert", "Unknown"),
        # Earlier words win over later ones.
        (["script", "network"], "network_connection", "Unknown"),
        (["credential", "execution"], "wazuh_alert", "Credential Access"),
    ],
)
def test_groups(spark, groups, category, tactic):
    g = F.col("g")
    assert values(spark, [(groups,)], "g array<string>", text.group_category(g), text.group_tactic(g)) == [
        (category, tactic)
    ]


def test_string_or_list(spark):
    rows = [('["a","b"]',), ("plain",), ("",), (None,), ("[]",), ("[not json",)]
    got = values(spark, rows, "x string", text.string_or_list(F.col("x")))
    assert [g[0] for g in got] == [["a", "b"], ["plain"], [], [], [], ["[not json"]]


def test_lookup_defaults(spark):
    got = values(spark, [("a",), (None,), ("zz",), ("b",)], "k string", text.lookup(F.col("k"), {"a": 1, "b": 2}, 0))
    assert [g[0] for g in got] == [1, 0, 0, 2]


def test_strip_and_first_usable(spark):
    rows = [("\u00a0\t x \u3000\n", "", None, "y")]
    got = values(
        spark, rows, "a string, b string, c string, d string",
        text.strip(F.col("a")), text.first_usable(F.col("b"), F.col("c"), F.col("d")),
    )
    assert got == [("x", "y")]


def test_one_json_value(spark):
    rows = ['{"a":1}', '{"a":1}}', '{"a":1},{"b":2}', '{"a":1} x', '{"a":', "{}", None]
    got = values(spark, [(r,) for r in rows], "x string", text.one_json_value(F.col("x")))
    assert [g[0] for g in got] == [True, False, False, False, False, True, False]
