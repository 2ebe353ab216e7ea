"""Tables, patterns and formats that results depend on.

They are data, not logic.  Anything that consumes or produces the tables of this
package must agree on them, so they are kept together, as plain text.
"""

# Category -> ordinal rank; anything else ranks 0.
CATEGORY_RANK = {
    "authentication": 1,
    "object_access": 2,
    "account_management": 3,
    "network_share": 4,
    "file_create": 5,
    "dns_query": 6,
    "registry_event": 7,
    "network_connection": 8,
    "pipe_event": 9,
    "process_termination": 10,
    "wmi_activity": 11,
    "process_access": 12,
    "image_load": 13,
    "create_remote_thread": 14,
    "script_execution": 15,
    "process_creation": 16,
    "credential_access": 17,
    "process_tamper": 18,
    "file_delete": 19,
    "file_create_stream_hash": 20,
}

# Log channel -> ordinal rank (case-sensitive); anything else ranks 0.
CHANNEL_RANK = {
    "Windows PowerShell": 1,
    "System": 2,
    "Microsoft-Windows-TaskScheduler/Operational": 3,
    "Security": 4,
    "security": 4,
    "Microsoft-Windows-PowerShell/Operational": 5,
    "Microsoft-Windows-WMI-Activity/Operational": 6,
    "Microsoft-Windows-Sysmon/Operational": 7,
}

# The feature columns, in order.
FEATURES = (
    "event_category_rank",
    "channel_rank",
    "event_id",
    "proc_rarity",
    "parent_proc_rarity",
    "parent_child_rarity",
    "user_rarity",
    "host_event_rarity",
    "has_cmd",
    "cmd_len",
    "cmd_has_encoding",
    "cmd_has_download",
    "hour",
)

# Command-line pattern, words (any letter case) and the length cap.
BASE64_BLOB = r"[A-Za-z0-9+/]{40,}={0,2}"
BASE64_SHORTEST = 40
DOWNLOAD_WORDS = (
    "DownloadString",
    "DownloadFile",
    "WebClient",
    "Invoke-WebRequest",
    "wget",
    "curl.exe",
    "bitsadmin",
)
COMMAND_LENGTH_CAP = 4096

# Event ids of the endpoint-monitor channel -> category.
SYSMON_CATEGORY = {
    1: "process_creation",
    3: "network_connection",
    5: "process_termination",
    7: "image_load",
    8: "create_remote_thread",
    10: "process_access",
    11: "file_create",
    12: "registry_event",
    13: "registry_event",
    15: "file_create_stream_hash",
    17: "pipe_event",
    22: "dns_query",
    23: "file_delete",
    25: "process_tamper",
}

# Event ids of the security audit channel -> category.
SECURITY_CATEGORY = {
    "authentication": (4624, 4625, 4648, 4768, 4769, 4771),
    "process_creation": (4688, 4689),
    "object_access": (4662, 4663, 4670),
    "account_management": (4720, 4722, 4723, 4724, 4725, 4726, 4738),
    "credential_access": (4776, 4798, 4799),
    "network_share": (5140, 5145),
}

# Alert rule-group words -> category, tried in this order.
RULE_GROUP_CATEGORY = (
    ("authentication", ("authentication", "logon", "login")),
    ("process_creation", ("process_creation", "sysmon_event1", "audit_process")),
    ("network_connection", ("network", "firewall", "connection")),
    ("registry_event", ("registry", "regscan")),
    ("script_execution", ("script", "powershell", "wscript")),
    ("file_create", ("file", "syscheck")),
    ("wmi_activity", ("wmi",)),
)
RULE_GROUP_DEFAULT = "wazuh_alert"

# Alert rule-group words -> tactic, tried in this order.
RULE_GROUP_TACTIC = (
    ("lateral", "Lateral Movement"),
    ("privilege", "Privilege Escalation"),
    ("credential", "Credential Access"),
    ("execution", "Execution"),
    ("persistence", "Persistence"),
    ("discovery", "Discovery"),
    ("collection", "Collection"),
    ("exfiltration", "Exfiltration"),
    ("command", "Command and Control"),
    ("defense", "Defense Evasion"),
    ("initial", "Initial Access"),
)
TACTIC_DEFAULT = "Unknown"

# False-positive label of a reply -> confidence that the alert is real.
REPLY_CONFIDENCE = {"low": 1.0, "medium": 0.6, "high": 0.2}
REPLY_CONFIDENCE_DEFAULT = 0.5

# Keys a reply must carry, without and with a rule behind the alert.
REPLY_KEYS_FULL = (
    "attack_technique",
    "attack_tactic",
    "description",
    "fp_assessment",
    "fp_reasoning",
    "investigation_steps",
)
REPLY_KEYS_RULE = ("fp_assessment", "fp_reasoning", "investigation_steps")
REPLY_MAX_STEPS = 5

# Thresholds of the routing rules.
TIER1_SCORE = 0.8
HIGH_PRIORITY_CONFIDENCE = 0.7
REVIEW_CONFIDENCE = 0.4
DISAGREEMENT_SCORE = 0.8
DISAGREEMENT_CONFIDENCE = 0.3
NOTIFY_ROUTES = ("high_priority", "analyst_review")

# Model settings.
TREES = 200
CONTAMINATION = 0.05
SEED = 42
SCORE_EPSILON = 1e-9

# Detection scorecard settings.
EXECUTED_STATUS = (2, 3)
DETECTION_WINDOW_SECONDS = 90

# Drift gates.
MAX_DRIFTED_FEATURES = 3
MIN_VOLUME_FRACTION = 0.70

# The white space that a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# IPv4-shaped text in a log line.
IPV4_SHAPE = r"(\p{Nd}{1,3}(?:\.\p{Nd}{1,3}){3})"
