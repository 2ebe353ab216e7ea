"""The catalog's results as SQL over the given tables, written without Spark in mind."""

from __future__ import annotations

from embertrace import fixed_values as fv

_TRIM = ", ".join(f"chr({ord(c)})" for c in fv.WHITESPACE)
_WS = f"concat({_TRIM})"


def _strip(text: str) -> str:
    return f"trim({text}, {_WS})"


def _rank(column: str, table: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


_F = fv.FEATURES

# The events as telemetry.
BASE = """
base AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k FROM events
),
sec AS (
  SELECT *, 'e' || event_id AS alert_id, 'h' || (user_id % 20) AS host, 'u' || user_id AS user_name,
    event_type || '.exe' AS proc,
    CASE WHEN k % 12 <> 11 THEN 'p' || (k % 12) || '.exe' END AS parent,
    CASE event_type WHEN 'signup' THEN 'authentication' WHEN 'error' THEN 'script_execution'
      WHEN 'click' THEN 'process_creation' WHEN 'view' THEN 'network_connection'
      WHEN 'purchase' THEN 'registry_event' ELSE 'other' END AS cat,
    CASE k % 4 WHEN 0 THEN 'Microsoft-Windows-Sysmon/Operational' WHEN 1 THEN 'Security'
      WHEN 2 THEN 'Microsoft-Windows-PowerShell/Operational' ELSE 'Application' END AS channel
  FROM base
)"""

SCORED = (
    BASE
    + """,
alerts AS (
  SELECT *, round(value / (value + 50), 6) AS score,
    CASE WHEN k % 9 <> 0 THEN round(value / (value + 50) * 100, 2) END AS pct,
    value / (value + 50) >= 0.6 AS is_anomaly,
    CASE WHEN NOT value / (value + 50) >= 0.6 THEN 'auto-close'
      WHEN round(value / (value + 50), 6) >= 0.8 THEN 'tier-1' ELSE 'tier-2' END AS score_routing
  FROM sec
)"""
)

TRIAGE = (
    SCORED
    + """,
rounds AS (
  SELECT a.alert_id, a.ts, a.score, a.pct, a.k, h.hour,
    CASE WHEN h.hour = 1 THEN 'medium' WHEN l.toxic = 1 OR a.k % 2 = 1 THEN 'high' WHEN l.quality = 1 THEN 'low'
      ELSE 'medium' END AS fp
  FROM alerts a JOIN labels l ON l.doc_id = a.event_id CROSS JOIN (VALUES (1), (2)) h(hour)
),
fused AS (
  SELECT *, CASE fp WHEN 'low' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS conf FROM rounds
),
triage AS (
  SELECT alert_id, score, ts + hour * INTERVAL 1 HOUR AS enriched_at, hour,
    CASE WHEN k % 3 = 0 THEN 'A' ELSE 'B' END AS path,
    'T10' || lpad((k % 60)::VARCHAR, 2, '0') AS technique, fp,
    round(pow(score * coalesce(pct / 100, score) * conf, 1.0::DOUBLE / 3), 4) AS combined, round(conf, 2) AS conf,
    score > 0.8 AND conf < 0.3 AS disagreement,
    CASE WHEN pow(score * coalesce(pct / 100, score) * conf, 1.0::DOUBLE / 3) >= 0.7 THEN 'high_priority'
      WHEN pow(score * coalesce(pct / 100, score) * conf, 1.0::DOUBLE / 3) >= 0.4 THEN 'analyst_review'
      ELSE 'auto-close' END AS fused_routing
  FROM fused
),
notes AS (
  SELECT alert_id, ts, CASE WHEN k % 2 = 0 THEN 'sent' ELSE 'failed' END AS status FROM sec WHERE k % 10 < 3
  UNION ALL SELECT alert_id, ts, 'failed' FROM sec WHERE k % 10 = 0
)"""
)

CURRENT = (
    TRIAGE
    + """,
now AS (
  SELECT a.*, t.enriched_at, t.path, t.technique, t.fp, t.combined, t.disagreement, t.fused_routing,
    t.alert_id IS NOT NULL AS enriched, n.alert_id IS NOT NULL AS notified, n.notified_at
  FROM alerts a
  LEFT JOIN (SELECT * FROM triage WHERE hour = 2) t USING (alert_id)
  LEFT JOIN (SELECT alert_id, max(ts) AS notified_at FROM notes WHERE status = 'sent' GROUP BY 1) n USING (alert_id)
),
queue AS (
  SELECT alert_id, round(score, 4) AS score, pct AS percentile, combined,
    coalesce(fused_routing, score_routing) AS routing, coalesce(disagreement, false) AS disagreement, enriched,
    cat AS category, proc AS process, coalesce(parent, '') AS parent, user_name AS "user", host,
    event_type AS dataset, score AS full_score
  FROM now
)"""
)

_CMD = f"""
cmd AS (
  SELECT doc_id, (length({_strip('text')}) > 0)::INT::DOUBLE AS has_cmd,
    least(length({_strip('text')}), 4096)::DOUBLE AS cmd_len,
    regexp_matches(text, '[A-Za-z0-9+/]{{40,}}={{0,2}}')::INT::DOUBLE AS cmd_has_encoding,
    regexp_matches(text, '(?i)({'|'.join(w.replace('.', '[.]') for w in fv.DOWNLOAD_WORDS)})')::INT::DOUBLE
      AS cmd_has_download
  FROM (SELECT doc_id, text || CASE WHEN doc_id % 40 = 7 THEN ' DownloadString' ELSE '' END AS text FROM documents) documents
)"""


def _feature_ctes(name: str = "feats", where: str = "true") -> str:
    """The feature rows of the events that satisfy a condition."""
    rarity = lambda key, part: (
        f"CASE WHEN {key} IS NULL THEN 0::DOUBLE ELSE "
        f"ln(1 + (count(*) OVER ())::DOUBLE / count(*) OVER (PARTITION BY {part})) END"
    )
    return f"""
{name} AS (
  SELECT alert_id,
    ({_rank('cat', fv.CATEGORY_RANK)})::DOUBLE AS event_category_rank,
    ({_rank('channel', fv.CHANNEL_RANK)})::DOUBLE AS channel_rank,
    k::DOUBLE AS event_id,
    {rarity('proc', 'proc')} AS proc_rarity,
    {rarity('parent', 'parent')} AS parent_proc_rarity,
    {rarity('parent', 'parent, proc')} AS parent_child_rarity,
    {rarity('user_name', 'user_name')} AS user_rarity,
    {rarity('host', 'host, cat')} AS host_event_rarity,
    has_cmd, cmd_len, cmd_has_encoding, cmd_has_download,
    hour(ts)::DOUBLE AS hour
  FROM sec LEFT JOIN cmd ON doc_id = sec.event_id % (SELECT count(*) FROM documents)
  WHERE {where}
)"""


FEATURES = BASE + "," + _CMD + "," + _feature_ctes()
_LONG = "UNPIVOT {} ON " + ", ".join(_F) + " INTO NAME feature VALUE value"
STATS = FEATURES + f""",
long AS (SELECT feature, value FROM ({_LONG.format('feats')})),
stats AS (
  SELECT feature, count(*) AS n, avg(value) AS mean,
    CASE WHEN min(value) = max(value) THEN 1.0::DOUBLE ELSE stddev_pop(value) END AS std
  FROM long GROUP BY feature
)"""
_ALL = FEATURES + f""",
long AS (SELECT alert_id, feature, value FROM ({_LONG.format('feats')})),
stats AS (
  SELECT feature, avg(value) AS mean,
    CASE WHEN min(value) = max(value) THEN 1.0::DOUBLE ELSE stddev_pop(value) END AS std
  FROM long GROUP BY feature
),
z AS (SELECT alert_id, feature, (value - mean) / std AS z FROM long JOIN stats USING (feature))"""
_POSITION = "CASE feature " + " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(_F)) + " END"

_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"

ORACLE: dict[str, str] = {}

ORACLE["pair_rarity_topk"] = f"""
WITH {BASE}
SELECT parent, proc, count(*) AS n, round(ln(1 + (SELECT count(*) FROM sec)::DOUBLE / count(*)), 6) AS pair_rarity
FROM sec WHERE parent IS NOT NULL GROUP BY 1, 2 ORDER BY n, parent, proc LIMIT 20"""

ORACLE["freq_tables"] = f"""
WITH {BASE}
SELECT 'proc' AS kind, proc AS key1, NULL::VARCHAR AS key2, count(*) AS n FROM sec GROUP BY proc
UNION ALL SELECT 'parent', parent, NULL, count(*) FROM sec WHERE parent IS NOT NULL GROUP BY parent
UNION ALL SELECT 'parent_child', parent, proc, count(*) FROM sec WHERE parent IS NOT NULL GROUP BY parent, proc
UNION ALL SELECT 'user', user_name, NULL, count(*) FROM sec GROUP BY user_name
UNION ALL SELECT 'host_event', host, cat, count(*) FROM sec GROUP BY host, cat
UNION ALL SELECT 'total', '', NULL, count(*) FROM sec"""

ORACLE["feature_matrix"] = f"""
WITH {FEATURES} SELECT alert_id, {', '.join(f'round({f}, 6) AS {f}' for f in _F)} FROM feats"""

ORACLE["category_rank"] = f"""
WITH {BASE} SELECT cat AS category, count(*) AS events, {_rank('cat', fv.CATEGORY_RANK)} AS category_rank
FROM sec GROUP BY cat"""

ORACLE["channel_rank"] = f"""
WITH {BASE} SELECT channel, count(*) AS events, {_rank('channel', fv.CHANNEL_RANK)} AS channel_rank
FROM sec GROUP BY channel"""

_SYSMON = "CASE code " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fv.SYSMON_CATEGORY.items()) + " ELSE 'sysmon_' || code END"
_AUDIT = (
    "CASE "
    + " ".join(f"WHEN code IN ({', '.join(map(str, ids))}) THEN '{c}'" for c, ids in fv.SECURITY_CATEGORY.items())
    + " ELSE 'security_' || code END"
)
_CATEGORY = (
    f"CASE WHEN contains(lower(channel), 'sysmon') THEN {_SYSMON} "
    f"WHEN contains(lower(channel), 'security') THEN {_AUDIT} "
    "WHEN contains(lower(channel), 'powershell') THEN 'script_execution' "
    "WHEN contains(lower(channel), 'wmi') THEN 'wmi_activity' ELSE 'other' END"
)
ORACLE["windows_categories"] = f"""
WITH {BASE}, coded AS (
  SELECT channel, (CASE WHEN channel = 'Security' THEN 4600 + k * 2 + trunc(value)::INT % 2 ELSE k END)::BIGINT AS code
  FROM sec)
SELECT channel, code, count(*) AS events, {_CATEGORY} AS category FROM coded GROUP BY channel, code"""

ORACLE["cmd_indicators"] = f"WITH {_CMD} SELECT * FROM cmd"

ORACLE["scaler_stats_table"] = f"""
WITH {STATS} SELECT feature, n, round(mean, 6) AS mean, round(std, 6) AS std FROM stats"""

ORACLE["zscores"] = f"""
WITH {_ALL}
SELECT alert_id, {', '.join(f"max(CASE WHEN feature = '{f}' THEN round(z, 6) END) AS {f}" for f in _F)}
FROM z GROUP BY alert_id"""

ORACLE["feature_power_table"] = f"""
WITH {_ALL} SELECT feature, round(avg(abs(z)), 6) AS mean_abs_z FROM z GROUP BY feature"""

ORACLE["top3_features"] = f"""
WITH {_ALL}, placed AS (
  SELECT alert_id, feature, z,
    row_number() OVER (PARTITION BY alert_id ORDER BY abs(z) DESC, {_POSITION} DESC) AS place FROM z)
SELECT alert_id, place::INT AS place, feature, round(z, 3) AS z_score FROM placed WHERE place <= 3"""

ORACLE["minmax_score"] = """
WITH b AS (SELECT min(-value) AS lo, max(-value) AS hi FROM events)
SELECT event_id, round(1 - (-value - lo) / (hi - lo + 1e-9::DOUBLE), 6) AS score FROM events, b"""

ORACLE["percentile_rank_avg"] = """
WITH r AS (
  SELECT event_id, rank() OVER (ORDER BY value) AS first, count(*) OVER (PARTITION BY value) AS ties,
    count(*) OVER () AS n FROM events)
SELECT event_id, round((first - 1 + (ties + 1) / 2.0::DOUBLE) / n * 100, 6) AS percentile FROM r"""

ORACLE["value_quantiles"] = """
SELECT event_type, """ + ", ".join(
    f"round(quantile_cont(value, {q}), 6) AS q{i + 1}" for i, q in enumerate((0.05, 0.25, 0.5, 0.75, 0.95))
) + " FROM events GROUP BY event_type"

ORACLE["score_routing"] = """
WITH b AS (SELECT min(-value) AS lo, max(-value) AS hi, quantile_cont(-value, 0.05) AS cut FROM events),
s AS (SELECT event_id, 1 - (-value - lo) / (hi - lo + 1e-9::DOUBLE) AS score, -value < cut AS is_anomaly FROM events, b)
SELECT event_id, round(score, 6) AS score, is_anomaly,
  CASE WHEN NOT is_anomaly THEN 'auto-close' WHEN score >= 0.8 THEN 'tier-1' ELSE 'tier-2' END AS route FROM s"""

ORACLE["combined_confidence"] = f"""
WITH {TRIAGE}
SELECT alert_id, {_TS.format('enriched_at')} AS enriched_at, fp AS fp_assessment, combined AS combined_confidence,
  conf AS llm_confidence, disagreement AS if_llm_disagreement, fused_routing AS routing_decision FROM triage"""

ORACLE["fused_routing"] = f"""
WITH {TRIAGE} SELECT fused_routing AS routing_decision, fp AS fp_assessment, count(*) AS events
FROM triage GROUP BY 1, 2"""

ORACLE["current_alerts"] = f"""
WITH {CURRENT}
SELECT alert_id, score AS anomaly_score, enriched, notified, score_routing, fused_routing,
  {_TS.format('enriched_at')} AS enriched_at, fp AS fp_assessment, {_TS.format('notified_at')} AS notified_at FROM now"""

_QUEUE_COLUMNS = (
    'alert_id, score, percentile, combined, routing, disagreement, enriched, category, process, parent, "user",'
    " host, dataset"
)
ORACLE["alert_state_delta"] = ORACLE["current_alerts"]
ORACLE["alert_queue"] = f"""
WITH {CURRENT} SELECT {_QUEUE_COLUMNS} FROM queue WHERE full_score >= 0.7 ORDER BY full_score DESC, alert_id LIMIT 100"""

ORACLE["disagreement"] = f"""
WITH {CURRENT} SELECT alert_id, score, percentile, combined, routing, category, process, dataset
FROM queue WHERE disagreement"""

ORACLE["anomaly_top10"] = f"""
WITH {CURRENT}
SELECT alert_id, score, proc AS process, cat AS category, event_type AS dataset, technique, fp
FROM now WHERE is_anomaly ORDER BY score DESC, alert_id LIMIT 10"""

ORACLE["score_preview"] = f"""
WITH {SCORED} SELECT alert_id, round(score, 4) AS score, is_anomaly, cat AS category, proc AS process,
  event_type AS dataset FROM alerts ORDER BY alerts.score DESC, alert_id LIMIT 10"""

ORACLE["unenriched_topn"] = f"""
WITH {CURRENT} SELECT alert_id, score AS anomaly_score FROM now
WHERE is_anomaly AND NOT enriched ORDER BY score DESC, alert_id LIMIT 50"""

_PENDING = "coalesce(fused_routing, score_routing) IN ('high_priority', 'analyst_review') AND NOT notified"
ORACLE["pending_notify"] = f"""
WITH {CURRENT} SELECT alert_id, combined AS combined_confidence, fused_routing FROM now
WHERE {_PENDING} ORDER BY combined DESC NULLS LAST, alert_id LIMIT 200"""

ORACLE["notify_payload"] = f"""
WITH {CURRENT}
SELECT alert_id, coalesce(fused_routing, score_routing) AS routing_decision, combined AS combined_confidence,
  score AS anomaly_score, path AS enrichment_path, {_TS.format('ts')} AS timestamp, host, 'scores' AS es_index,
  proc AS alert_process
FROM now WHERE {_PENDING}"""

ORACLE["kpi_row"] = f"""
WITH {CURRENT}
SELECT count(score) AS total_events, count(*) FILTER (is_anomaly) AS anomalies, count(*) FILTER (enriched) AS enriched,
  min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS avg_score,
  round(count(*) FILTER (is_anomaly) * 100.0::DOUBLE / greatest(count(score), 1), 6) AS anomaly_pct,
  round(count(*) FILTER (enriched) * 100.0::DOUBLE / greatest(count(*) FILTER (is_anomaly), 1), 6) AS enriched_pct,
  round(sum(score), 4) AS sum_score
FROM now"""

ORACLE["run_metric_rows"] = f"""
WITH {SCORED}, m AS (
  SELECT count(*)::DOUBLE AS events_scored, (count(*) FILTER (is_anomaly))::DOUBLE AS anomaly_count,
    round((count(*) FILTER (is_anomaly))::DOUBLE / count(*), 4) AS anomaly_rate, max(score) AS top_score,
    round(quantile_cont(score, 0.95), 6) AS score_p95 FROM alerts)
SELECT 'run-1' AS run_id, 'metric' AS kind, key, value
FROM (UNPIVOT m ON events_scored, anomaly_count, anomaly_rate, top_score, score_p95 INTO NAME key VALUE value)"""

ORACLE["anomaly_rate_daily"] = f"""
WITH {SCORED}
SELECT {_TS.format("date_trunc('day', ts)::TIMESTAMP")} AS window_start, count(*) AS events,
  count(*) FILTER (is_anomaly) AS anomalies,
  round((count(*) FILTER (is_anomaly))::DOUBLE / count(*), 6) AS anomaly_rate
FROM alerts GROUP BY 1"""

ORACLE["score_hist50"] = f"""
WITH {SCORED} SELECT least(floor(score * 50)::BIGINT + 1, 50) AS bin, count(*) AS n FROM alerts GROUP BY 1"""

ORACLE["mean_score_top20"] = f"""
WITH {SCORED} SELECT user_name AS source_ip, round(avg(score), 6) AS mean_score
FROM alerts WHERE score > 0.75 GROUP BY 1 ORDER BY avg(score) DESC, 1 LIMIT 20"""

ORACLE["source_counts_total"] = """
SELECT source, grouping(source) = 1 AS is_total, count(*) AS events FROM documents GROUP BY ROLLUP (source)"""

ORACLE["parent_counts_total"] = f"""
WITH {BASE} SELECT parent, grouping(parent) = 1 AS is_total, count(*) AS events FROM sec GROUP BY ROLLUP (parent)"""

ORACLE["category_counts"] = f"""
WITH {BASE} SELECT cat AS category, event_type AS source_dataset, count(*) AS events FROM sec GROUP BY 1, 2"""

ORACLE["triage_summary"] = f"""
WITH {CURRENT}
SELECT count(*) AS processed, count(*) FILTER (enriched) AS succeeded, count(*) FILTER (NOT enriched) AS failed,
  count(*) FILTER (coalesce(disagreement, false)) AS disagreements FROM now WHERE is_anomaly"""

ORACLE["disagreement_details"] = f"""
WITH {CURRENT} SELECT alert_id, score, proc AS process, combined AS combined_confidence,
  technique AS attack_technique, fp AS fp_assessment FROM now WHERE disagreement"""

ORACLE["notify_summary"] = f"""
WITH {TRIAGE}
SELECT count(*) AS total_fetched, count(*) FILTER (status = 'sent') AS sent,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IS NULL) AS skipped
FROM alerts LEFT JOIN (SELECT alert_id, CASE WHEN bool_or(status = 'sent') THEN 'sent' ELSE 'failed' END AS status
  FROM notes GROUP BY 1) USING (alert_id) WHERE score_routing <> 'auto-close'"""

ORACLE["stream_notify"] = f"""
WITH {TRIAGE}, asked AS (
  SELECT alert_id, substr(alert_id, 2)::BIGINT % 5 = 0 AS hard,
    coalesce(bool_or(fused_routing <> 'auto-close') FILTER (hour = 1), false) AS first,
    coalesce(bool_or(fused_routing <> 'auto-close') FILTER (hour = 2), false) AS second,
    max(combined) FILTER (hour = 1) AS combined_1, max(combined) FILTER (hour = 2) AS combined_2
  FROM triage GROUP BY 1)
SELECT 0::BIGINT AS batch, alert_id, 1 AS attempt, CASE WHEN hard THEN 'failed' ELSE 'sent' END AS status,
  combined_1 AS combined_confidence FROM asked WHERE first
UNION ALL SELECT 1, alert_id, 2, 'sent', CASE WHEN second THEN combined_2 ELSE combined_1 END FROM asked WHERE first AND hard
UNION ALL SELECT 1, alert_id, 1, CASE WHEN hard THEN 'failed' ELSE 'sent' END, combined_2 FROM asked WHERE NOT first AND second"""

ORACLE["stream_bridge_skips"] = """
SELECT (event_id % 3)::INT AS batch, count(*) FILTER (event_id % 20 <> 7 AND event_id % 10 NOT IN (3, 4)) AS indexed,
  count(*) FILTER (event_id % 20 <> 7 AND event_id % 10 IN (3, 4)) AS skipped,
  count(*) FILTER (event_id % 20 <> 7 AND event_id % 10 = 3) AS malformed,
  count(*) FILTER (event_id % 20 <> 7 AND event_id % 10 = 4) AS no_object,
  count(DISTINCT CASE WHEN event_id % 20 <> 7 AND event_id % 10 NOT IN (3, 4) THEN CAST(props->>'$.k' AS INTEGER) END) AS rules
FROM events GROUP BY 1"""

ORACLE["tactic_counts"] = f"""
WITH {BASE} SELECT CASE k % 4 WHEN 0 THEN 'Lateral Movement' WHEN 1 THEN 'Execution' WHEN 2 THEN 'Discovery'
  ELSE 'Unknown' END AS tactic, count(*) AS events FROM sec GROUP BY 1"""

ORACLE["prompt_facts"] = f"""
WITH {BASE}
SELECT alert_id, 'anomaly_score: ' || printf('%.4f', value / 1000) || '  (' ||
  CASE WHEN k % 9 <> 0 THEN printf('%.1f', value) || 'th percentile' ELSE 'percentile unavailable' END || ')' ||
  chr(10) || 'event.category: ' || cat || chr(10) || 'event.channel: ' || channel ||
  chr(10) || 'process.name: ' || proc || chr(10) || 'process.parent.name: ' || coalesce(parent, 'unknown') ||
  chr(10) || 'process.command_line: ' || CASE WHEN text IS NULL OR text = '' THEN '(not recorded)' ELSE text END ||
  chr(10) || 'user.name: ' || user_name || chr(10) || 'host.name: ' || host ||
  chr(10) || 'source_dataset: ' || event_type || chr(10) || 'top_contributing_features: proc_rarity (z=' ||
  printf('%+.2f', k / 4.0::DOUBLE - 12) || ', ' || CASE WHEN k / 4.0 - 12 > 0 THEN 'above' ELSE 'below' END || ' baseline)'
  AS facts
FROM sec LEFT JOIN (SELECT doc_id, text || CASE WHEN doc_id % 40 = 7 THEN ' DownloadString' ELSE '' END AS text FROM documents) documents ON doc_id = sec.event_id % (SELECT count(*) FROM documents)"""

ORACLE["prompt_text"] = f"""
WITH {SCORED}, p AS (
  SELECT *, k % 3 = 0 AS backed, k / 8.0::DOUBLE AS x FROM alerts)
SELECT alert_id, CASE WHEN backed THEN 'A' ELSE 'B' END AS enrichment_path, true AS names_rarity,
  NOT backed AS asks_technique, true AS asks_steps,
  CASE WHEN pct IS NOT NULL THEN printf('%.1f', pct) || 'th percentile'
    WHEN backed THEN 'high percentile' ELSE 'percentile unavailable' END AS rank_text,
  CASE WHEN backed THEN ''
    WHEN k % 6 = 0 THEN '(not available — event was scored before feature attribution was added)'
    ELSE 'proc_rarity (z=' || printf('%+.2f', round(x, 3)) || ', ' || CASE WHEN round(x, 3) > 0 THEN 'above' ELSE 'below' END
      || ' baseline); parent_child_rarity (z=' || printf('%+.2f', round(x - 1, 3)) || ', '
      || CASE WHEN round(x - 1, 3) > 0 THEN 'above' ELSE 'below' END
      || ' baseline); hour (z=' || printf('%+.2f', round(x - 2, 3)) || ', '
      || CASE WHEN round(x - 2, 3) > 0 THEN 'above' ELSE 'below' END || ' baseline)' END AS feature_text
FROM p"""

ORACLE["parse_reply"] = """
WITH r AS (
  SELECT conv_id || '-' || turn AS alert_id, role, text, conv_id * 7 + turn AS n FROM conversations),
f AS (
  SELECT *, n % 2 = 0 AS backed, n % 100 / 100.0::DOUBLE AS score,
    CASE WHEN n % 3 <> 0 THEN n % 100 * 1.0::DOUBLE END AS pct,
    CASE n % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'medium' END AS label
  FROM r WHERE n % 5 <> 2 AND n % 5 <> 3 AND n % 6 <> 0),
c AS (
  SELECT *, CASE label WHEN 'low' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS conf,
    pow(score * coalesce(pct / 100, score) *
      CASE label WHEN 'low' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END, 1.0::DOUBLE / 3) AS raw
  FROM f)
SELECT alert_id, CASE WHEN backed THEN 'A' ELSE 'B' END AS enrichment_path,
  CASE WHEN n % 8 <> 4 THEN 'T1' || lpad((n % 500)::VARCHAR, 3, '0') WHEN n % 16 = 12 THEN 'T4242' ELSE 'wazuh:R' || n END AS attack_technique,
  CASE WHEN n % 8 <> 6 THEN role ELSE 'Defense Evasion' END AS attack_tactic,
  CASE WHEN n % 16 <> 4 THEN text ELSE 'Wazuh rule R' || n || ': desc' END AS description,
  label AS fp_assessment, 'seen before' AS fp_reasoning,
  array_to_string(list_transform(range(1, least(n % 9 + 2, 6)), lambda i: 'step ' || i), '|') AS steps,
  round(raw, 4) AS combined_confidence, conf AS llm_confidence,
  score > 0.8 AND conf < 0.3 AS if_llm_disagreement,
  CASE WHEN raw >= 0.7 THEN 'high_priority' WHEN raw >= 0.4 THEN 'analyst_review' ELSE 'auto-close' END AS routing_decision
FROM c"""

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
LOGS = f"""
base AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k FROM events
),
shaped AS (
  SELECT *, '10.' || (k % 4) || '.' || (k % 200) || '.7' AS address FROM base WHERE k % 5 <> 3
),
logs AS (
  SELECT CASE WHEN k % 10 = 0 THEN ts ELSE TIMESTAMP '2024-02-01' END AS timestamp,
    CASE WHEN k % 5 IN (0, 1) THEN address WHEN k % 5 = 2 THEN '1.2.3.4' END AS source_ip,
    CASE WHEN k % 5 = 0 THEN event_type ELSE 'generic' END AS event_type,
    CASE k % 5 WHEN 1 THEN 'sshd: failed login of ' || user_id || ' from ' || address || ' port 22'
      WHEN 2 THEN '{{broken ' || user_id || ' 1.2.3.4' WHEN 4 THEN 'plain ' || event_type
      ELSE '{{' || CASE WHEN k % 10 = 0 THEN '"timestamp":"' || {_ISO} || '",' ELSE '' END ||
        '"source_ip":"' || address || '","event_type":"' || event_type || '","anomaly_score":' END AS raw_head,
    k % 5 = 0 AS is_json, CASE WHEN k % 5 = 0 THEN k / 100.0::DOUBLE END AS anomaly_score, k
  FROM shaped
)"""

ORACLE["log_events"] = f"""
WITH {LOGS}
SELECT {_TS.format('timestamp')} AS timestamp, source_ip, event_type, k % 5 IN (0, 2) AS raw_is_object,
  count(*) AS lines, round(sum(anomaly_score), 6) AS score_sum,
  min(raw_head || CASE WHEN is_json THEN anomaly_score::VARCHAR || '}}' ELSE '' END) AS first_raw
FROM logs GROUP BY 1, 2, 3, 4"""

ORACLE["log_triage_top10"] = f"""
WITH {LOGS}
SELECT {_TS.format('timestamp')} AS timestamp, source_ip, event_type,
  raw_head || anomaly_score::VARCHAR || '}}' AS raw, anomaly_score
FROM logs WHERE anomaly_score >= 0.75 ORDER BY anomaly_score DESC, 1, 2, 4 LIMIT 10"""
for _name in ("log_events", "log_triage_top10"):
    ORACLE[_name] = ORACLE[_name].replace("'}}'", "'}'")

ORACLE["ip_extract_logs"] = f"""
WITH texts AS (
  SELECT 'documents' AS origin, doc_id AS id, text FROM documents
  UNION ALL SELECT 'pages', page_id, html FROM pages),
lines AS (SELECT origin, id, {_strip('unnest(string_split(text, chr(10)))')} AS line FROM texts),
found AS (
  SELECT origin, id, line, nullif(regexp_extract(line, '(\\p{{Nd}}{{1,3}}(?:\\.\\p{{Nd}}{{1,3}}){{3}})', 1), '') AS ip
  FROM lines WHERE line <> '')
SELECT origin, id, count(*) AS lines, count(ip) AS with_address, min(ip) AS first_address, max(ip) AS last_address,
  sum(length(line))::BIGINT AS characters
FROM found GROUP BY 1, 2"""

ORACLE["basename_urls"] = """
SELECT page_id, nullif(lower(string_split(replace(url, '\\', '/'), '/')[-1]), '') AS base FROM pages"""

WINDOWS = f"""
base AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k FROM events
),
shaped AS (
  SELECT *, 'u' || user_id AS u,
    CASE WHEN k % 4 = 0 THEN k WHEN k % 4 = 1 THEN 4600 + k * 2 WHEN k % 8 = 2 THEN 4104 ELSE 0 END AS code,
    CASE k % 4 WHEN 0 THEN 'Microsoft-Windows-Sysmon/Operational' WHEN 1 THEN 'Security'
      WHEN 2 THEN 'Microsoft-Windows-PowerShell/Operational' ELSE 'WMI-Log' END AS channel
  FROM base WHERE k % 20 NOT IN (18, 19)
),
windows AS (
  SELECT sha256('raw|events|' || event_id) AS alert_id,
    CASE WHEN k % 7 <> 0 THEN ts ELSE date_trunc('second', ts) END AS ts,
    CASE WHEN k % 9 <> 0 THEN 'H' || (user_id % 20) ELSE 'fallback-host' END AS host,
    CASE WHEN k % 6 = 0 THEN NULL WHEN k % 4 < 2 THEN u ELSE 'T' || u END AS user_name,
    CASE WHEN k % 5 <> 0 THEN event_type || '.exe' WHEN k % 10 = 0 THEN 'alt.exe' END AS process,
    CASE WHEN k % 3 <> 0 THEN 'p' || (k % 12) || '.exe' END AS parent,
    {_CATEGORY} AS category, code::VARCHAR AS event_id, 'raw' AS source_dataset,
    CASE WHEN k % 4 = 1 THEN 'run ' || u WHEN k % 2 = 0 THEN 'script of ' || u END AS command_line,
    channel, CASE WHEN k % 2 = 0 THEN 'recorded,' || event_type ELSE '' END AS tags, k % 8 = 3 AS is_bad
  FROM shaped
)"""
ORACLE["reingest_ids"] = f"""
WITH {WINDOWS}, days AS (SELECT 2 * count(*) AS n, dayofweek(ts) + 1 AS day FROM shaped GROUP BY 2)
SELECT sum(n)::BIGINT AS lines, sum(n)::BIGINT AS ids, (sum(n) FILTER (day BETWEEN 2 AND 5))::BIGINT AS both FROM days"""
ORACLE["normalise_events"] = f"WITH {WINDOWS} SELECT * REPLACE ({_TS.format('ts')} AS ts) FROM windows"

ENDPOINT = """
alerts_base AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k FROM events
),
endpoint AS (
  SELECT 'a' || event_id AS alert_id, ts,
    CASE WHEN k % 3 = 2 THEN 'bare' ELSE 'Host' || (user_id % 20) END AS host,
    CASE WHEN k % 2 = 0 THEN 'u' || user_id ELSE 'svc' END AS user_name,
    CASE WHEN k % 2 = 0 THEN 'a.exe' ELSE 'b.exe' END AS process,
    CASE WHEN k % 2 = 0 THEN 'p.exe' END AS parent,
    CASE k % 6 WHEN 0 THEN 'authentication' WHEN 1 THEN 'process_creation' WHEN 2 THEN 'network_connection'
      WHEN 3 THEN 'registry_event' WHEN 4 THEN 'script_execution' ELSE 'wazuh_alert' END AS category,
    k::VARCHAR AS event_id, 'wazuh' AS source_dataset,
    CASE k % 4 WHEN 0 THEN 'T1003' WHEN 1 THEN 'T1021' WHEN 2 THEN 'T1110' END AS technique,
    event_type AS description, k % 16 AS level,
    CASE k % 6 WHEN 0 THEN 'Windows_Logon' WHEN 1 THEN 'windows,Sysmon_Event1' WHEN 2 THEN 'firewall'
      WHEN 3 THEN 'RegScan,x' WHEN 4 THEN 'powershell' ELSE '' END AS groups,
    CASE WHEN k % 3 = 2 THEN '' ELSE 'Host' || (user_id % 20) END AS agent_name
  FROM alerts_base
)"""
ORACLE["normalise_alerts"] = f"WITH {ENDPOINT} SELECT * REPLACE ({_TS.format('ts')} AS ts) FROM endpoint"

ORACLE["union_sources"] = f"""
WITH {WINDOWS}, {ENDPOINT}
SELECT source_dataset, category, technique, count(*) AS events FROM (
  SELECT source_dataset, category, NULL AS technique FROM windows
  UNION ALL SELECT source_dataset, category, technique FROM endpoint) GROUP BY 1, 2, 3"""

ORACLE["stream_bridge"] = f"""
WITH {ENDPOINT} SELECT category, host, count(*) AS events FROM endpoint GROUP BY 1, 2"""

ORACLE["coerce_round"] = """
SELECT event_id, CASE WHEN event_type <> 'error' THEN round(value / 7, 6) END AS score,
  CASE WHEN event_type <> 'error' THEN round(value / 7, 2) END AS percentile FROM events"""

ORACLE["full_scan"] = f"""
SELECT 'e' || event_id AS alert_id, {_TS.format('ts')} AS ts, event_type AS source_dataset FROM events"""

ORACLE["incremental_scan"] = f"""
SELECT {_TS.format('max(ts)')} AS last_seen, count(*) AS events FROM events WHERE ts > TIMESTAMP '2024-01-20'"""

ORACLE["current_window"] = """
SELECT ts::DATE::VARCHAR AS event_date, count(*) AS events FROM events WHERE ts > TIMESTAMP '2024-01-24' GROUP BY 1"""

ORACLE["lookback_scan"] = """
SELECT event_id, event_type, user_id AS source_ip FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-30'"""

ORACLE["recent_rows"] = f"""
SELECT 'e' || event_id AS alert_id, {_TS.format('ts')} AS ts FROM events ORDER BY events.ts DESC, 1 LIMIT 500"""

ORACLE["last_valid_run"] = f"""
SELECT 'run' || lpad(o_orderkey::VARCHAR, 9, '0') AS run_id, {_TS.format('o_orderdate')} AS completed_at FROM orders
WHERE o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AND o_orderstatus <> 'F'
ORDER BY o_orderdate DESC, run_id DESC LIMIT 1"""

STEPS = (
    SCORED
    + """,
steps AS (
  SELECT 'L' || event_id AS link_id,
    CASE WHEN k % 6 <> 0 THEN 'T1' || lpad((k % 40)::VARCHAR, 3, '0')
      WHEN k % 12 <> 0 THEN 'unknown:ability ' || (k % 40) ELSE 'unknown:L' || event_id END AS technique_id,
    CASE WHEN k % 12 <> 0 THEN 'ability ' || (k % 40) ELSE '(unknown)' END AS ability_name,
    CASE WHEN k % 14 <> 0 THEN 'h' || (user_id % 20) ELSE 'unknown' END AS host,
    ts - k * INTERVAL 1 SECOND AS executed_at, k % 5 AS status
  FROM sec
  WHERE event_type = 'purchase' AND k % 5 IN (2, 3)
    AND CASE WHEN k % 11 = 0 THEN k % 22 <> 0 ELSE k % 13 <> 0 END
),
hits AS (
  SELECT s.link_id, s.executed_at, a.ts, a.score, a.pct, a.alert_id,
    row_number() OVER (PARTITION BY s.link_id ORDER BY a.score DESC, a.ts, a.alert_id) AS place
  FROM steps s JOIN alerts a
    ON a.host = s.host AND a.ts BETWEEN s.executed_at AND s.executed_at + INTERVAL 90 SECOND
  WHERE a.is_anomaly AND a.score >= 0.65
),
per_step AS (
  SELECT link_id, count(*) AS n, max(CASE WHEN place = 1 THEN score END) AS score,
    max(CASE WHEN place = 1 THEN pct END) AS pct,
    max(CASE WHEN place = 1 THEN date_diff('microsecond', executed_at, ts) END) AS best_us,
    min(date_diff('microsecond', executed_at, ts)) AS first_us
  FROM hits GROUP BY link_id
),
results AS (
  SELECT s.link_id, technique_id, ability_name, host, executed_at, n IS NOT NULL AS detected,
    round(coalesce(score, 0), 4) AS max_score, round(pct, 2) AS max_percentile,
    round(best_us / 1e6::DOUBLE, 1) AS best_latency_s, round(first_us / 1e6::DOUBLE, 1) AS first_latency_s,
    least(coalesce(n, 0), 10) AS detecting_events, coalesce(n, 0) AS all_detecting_events
  FROM steps s LEFT JOIN per_step USING (link_id)
)"""
)
ORACLE["exec_steps"] = f"WITH {STEPS} SELECT * REPLACE ({_TS.format('executed_at')} AS executed_at) FROM steps"
ORACLE["detections_90s"] = f"WITH {STEPS} SELECT * REPLACE ({_TS.format('executed_at')} AS executed_at) FROM results"
ORACLE["top_detections"] = f"""
WITH {STEPS} SELECT link_id, place::INT AS rank, alert_id, score, pct AS percentile, {_TS.format('ts')} AS detected_at
FROM hits WHERE place <= 10"""
ORACLE["detection_scorecard"] = f"""
WITH {STEPS}
SELECT count(*) AS techniques_executed, count(*) FILTER (detected) AS detected, count(*) FILTER (NOT detected) AS missed,
  coalesce(round((count(*) FILTER (detected))::DOUBLE / nullif(count(*), 0), 4), 0) AS detection_rate,
  round(avg(best_latency_s) FILTER (detected), 1) AS avg_detection_latency_seconds FROM results"""
ORACLE["missed_techniques"] = f"""
WITH {STEPS}
SELECT technique_id, count(*) AS missed_steps, arg_min(ability_name, (executed_at, link_id)) AS ability_name
FROM results WHERE NOT detected GROUP BY 1"""
ORACLE["detection_split"] = f"""
WITH {STEPS} SELECT CASE WHEN detected THEN 'Detected' ELSE 'Missed' END AS status, count(*) AS steps
FROM results GROUP BY 1"""
ORACLE["step_table"] = f"""
WITH {STEPS} SELECT technique_id, ability_name, host, detected, CASE WHEN detected THEN max_score END AS max_score,
  best_latency_s AS latency_s, detecting_events AS events, link_id FROM results"""
_TACTICS = "CASE try_cast(nullif(regexp_extract(technique_id, '^T1(\\d+)$', 1), '') AS INT) % 11 " + " ".join(
    f"WHEN {i} THEN '{tactic}'" for i, (_, tactic) in enumerate(fv.RULE_GROUP_TACTIC)
) + " ELSE 'Unknown' END"
ORACLE["coverage_by_tactic"] = f"""
WITH {STEPS}, per AS (
  SELECT {_TACTICS} AS tactic, technique_id, max(detected::INT) AS hit FROM results GROUP BY 1, 2)
SELECT tactic, count(*) AS techniques, sum(hit)::BIGINT AS covered, (count(*) - sum(hit))::BIGINT AS gap
FROM per GROUP BY 1"""
ORACLE["stream_detections"] = ORACLE["detections_90s"]

_BEFORE, _AFTER = "ts < TIMESTAMP '2024-01-21'", "ts >= TIMESTAMP '2024-01-21'"
DRIFT = (
    BASE + "," + _CMD + "," + _feature_ctes("ref_feats", _BEFORE) + "," + _feature_ctes("cur_feats", _AFTER)
    + f""",
both_windows AS (
  SELECT feature, value, 1 AS is_ref FROM ({_LONG.format('ref_feats')})
  UNION ALL SELECT feature, value, 0 FROM ({_LONG.format('cur_feats')})
),
hist AS (
  SELECT feature, value, sum(is_ref) AS r, sum(1 - is_ref) AS c FROM both_windows GROUP BY 1, 2
),
cum AS (
  SELECT feature, value, r, c, sum(r) OVER up AS cr, sum(c) OVER up AS cc,
    sum(r) OVER (PARTITION BY feature) AS nr, sum(c) OVER (PARTITION BY feature) AS nc,
    lead(value) OVER (PARTITION BY feature ORDER BY value) AS next_value
  FROM hist WINDOW up AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)
),
dist AS (
  SELECT feature, max(abs(cr::DOUBLE / nr - cc::DOUBLE / nc)) AS ks,
    sum(abs(cr::DOUBLE / nr - cc::DOUBLE / nc) * coalesce(next_value - value, 0)) AS w1 FROM cum GROUP BY 1
),
spread AS (SELECT feature, stddev_pop(value) AS s FROM both_windows WHERE is_ref = 1 GROUP BY 1),
drifted AS (
  SELECT feature, ks, w1, w1 / greatest(s, 0.001::DOUBLE) AS w1_norm, w1 / greatest(s, 0.001::DOUBLE) >= 0.1 AS drifted
  FROM dist JOIN spread USING (feature)
),
gates AS (
  SELECT 'drifted_features' AS name, count(*) FILTER (drifted) AS value, 3::BIGINT AS "limit",
    count(*) FILTER (drifted) <= 3 AS passed FROM drifted
  UNION ALL
  SELECT 'current_rows', n_cur, floor(n_ref * 0.7::DOUBLE)::BIGINT, n_cur >= floor(n_ref * 0.7::DOUBLE) AND n_cur > 0
  FROM (SELECT (SELECT count(*) FROM cur_feats) AS n_cur, (SELECT count(*) FROM ref_feats) AS n_ref)
)"""
)
ORACLE["drift_ks"] = f"WITH {DRIFT} SELECT feature, round(ks, 6) AS ks FROM dist"
ORACLE["drift_w1"] = f"""
WITH {DRIFT} SELECT feature, round(w1, 5) AS w1, round(w1_norm, 5) AS w1_norm, drifted FROM drifted"""
ORACLE["drift_psi"] = (
    f"WITH {DRIFT}, edges AS (SELECT feature, "
    + ", ".join(f"min(CASE WHEN cr * 10 >= nr * {i} THEN value END) AS e{i}" for i in range(1, 10))
    + " FROM cum GROUP BY feature), bins AS (SELECT feature, "
    + " + ".join(f"(value > e{i})::INT" for i in range(1, 10))
    + """ AS bin, sum(r)::DOUBLE / max(nr) AS r, sum(c)::DOUBLE / max(nc) AS c
  FROM cum JOIN edges USING (feature) GROUP BY 1, 2)
SELECT feature, round(sum((greatest(c, 1e-4::DOUBLE) - greatest(r, 1e-4::DOUBLE)) *
  ln(greatest(c, 1e-4::DOUBLE) / greatest(r, 1e-4::DOUBLE))), 6) AS psi FROM bins GROUP BY 1"""
)
ORACLE["drift_gates"] = f"WITH {DRIFT} SELECT * FROM gates"
ORACLE["drift_verdict"] = f"""
WITH {DRIFT} SELECT count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
  bool_and(passed) AS all_passed FROM gates"""

ORACLE["quality_profile"] = f"""
WITH {FEATURES}, long AS (SELECT feature, value FROM ({_LONG.format('feats')})),
ranked AS (SELECT feature, value, cume_dist() OVER (PARTITION BY feature ORDER BY value) AS share,
  count(*) OVER (PARTITION BY feature, value) AS same FROM long)
SELECT feature, 0::BIGINT AS nulls, count(*) AS n, count(DISTINCT value) AS distinct_values,
  count(DISTINCT value) <= 1 AS is_constant,
  round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, round(avg(value), 6) AS mean_value,
  round(min(value) FILTER (share >= 0.25), 6) AS p25, round(min(value) FILTER (share >= 0.5), 6) AS p50,
  round(min(value) FILTER (share >= 0.75), 6) AS p75, round(max(same)::DOUBLE / count(*), 6) AS most_common_share,
  round(stddev_pop(value), 6) AS std_value
FROM ranked GROUP BY feature"""

LEGACY = """
rows_in AS (
  SELECT 'e' || event_id AS alert_id,
    CASE WHEN CAST(props->>'$.k' AS INTEGER) <> 0 THEN event_type END AS event_type,
    '10.0.' || (user_id // 250) || '.' || (user_id % 250) AS source_ip FROM events
),
coded AS (
  SELECT alert_id,
    CASE WHEN event_type IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY event_type NULLS LAST) - 1 END::BIGINT AS event_type_code,
    (dense_rank() OVER (ORDER BY source_ip) - 1)::BIGINT AS source_ip_code FROM rows_in
)"""
ORACLE["categorical_codes"] = f"WITH {LEGACY} SELECT * FROM coded"

ORACLE["lof_scores"] = f"""
WITH {LEGACY},
scale AS (SELECT stddev_pop(event_type_code) AS s0, stddev_pop(source_ip_code) AS s1 FROM coded),
pts AS (SELECT event_type_code AS a, source_ip_code AS b, count(*) AS w FROM coded GROUP BY 1, 2),
pairs AS (
  SELECT p.a, p.b, q.a AS qa, q.b AS qb, CASE WHEN p.a = q.a AND p.b = q.b THEN q.w - 1 ELSE q.w END AS w,
    sqrt(((p.a - q.a) / s0) * ((p.a - q.a) / s0) + ((p.b - q.b) / s1) * ((p.b - q.b) / s1)) AS d
  FROM pts p, pts q, scale),
cum AS (
  SELECT *, sum(w) OVER (PARTITION BY a, b ORDER BY d) AS upto FROM pairs WHERE w > 0),
kd AS (SELECT a, b, min(d) AS kdist FROM cum WHERE upto >= 20 GROUP BY 1, 2),
near AS (SELECT c.*, kdist FROM cum c JOIN kd USING (a, b) WHERE d <= kdist),
lrd AS (
  SELECT n.a, n.b, 1 / (sum(greatest(n.d, k.kdist) * n.w) / sum(n.w) + 1e-10::DOUBLE) AS lrd
  FROM near n JOIN kd k ON k.a = n.qa AND k.b = n.qb GROUP BY 1, 2),
lof AS (
  SELECT n.a, n.b, sum(l.lrd * n.w) / sum(n.w) / any_value(o.lrd) AS lof
  FROM near n JOIN lrd l ON l.a = n.qa AND l.b = n.qb JOIN lrd o ON o.a = n.a AND o.b = n.b GROUP BY 1, 2)
SELECT alert_id, round(ln(lof), 6) + 0.0::DOUBLE AS log_factor FROM coded JOIN lof ON a = event_type_code AND b = source_ip_code"""

ORACLE["drift_from_days"] = f"""
SELECT * FROM ({ORACLE['drift_ks']}) JOIN ({ORACLE['drift_w1']}) USING (feature) JOIN ({ORACLE['drift_psi']}) USING (feature)
JOIN ({ORACLE['quality_profile']}) USING (feature)"""


def _entry(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][event_id % {len(values)} + 1]"


_GROUP_WORDS = [w for w, _ in fv.RULE_GROUP_TACTIC] + [w for _, group in fv.RULE_GROUP_CATEGORY for w in group] + ["other"]
_FIRST_TACTIC = "CASE " + " ".join(f"WHEN contains(g, '{w}') THEN '{tactic}'" for w, tactic in fv.RULE_GROUP_TACTIC) + f" ELSE '{fv.TACTIC_DEFAULT}' END"
_FIRST_CATEGORY = (
    "CASE "
    + " ".join(f"WHEN {' OR '.join(f"contains(g, '{w}')" for w in group)} THEN '{category}'" for category, group in fv.RULE_GROUP_CATEGORY)
    + f" ELSE '{fv.RULE_GROUP_DEFAULT}' END"
)
ORACLE["rule_tables"] = f"""
WITH r AS (
  SELECT {_entry([*fv.CATEGORY_RANK, 'none such'])} AS c, {_entry([*fv.CHANNEL_RANK, 'windows powershell'])} AS ch, {_entry(_GROUP_WORDS)} AS g
  FROM events)
SELECT {_rank('c', fv.CATEGORY_RANK)} AS category_rank, {_rank('ch', fv.CHANNEL_RANK)} AS channel_rank,
  {_FIRST_TACTIC} AS tactic, {_FIRST_CATEGORY} AS rule_category, count(*) AS events FROM r GROUP BY 1, 2, 3, 4"""

_ROUND_TRIP = {
    "events": "SELECT k AS x FROM base",
    "events_since": "SELECT k FROM base WHERE ts > TIMESTAMP '2024-01-20'",
    "triage": "SELECT combined FROM triage",
    "notifications": "SELECT (status = 'sent')::INT FROM notes",
    "scores": "SELECT score FROM alerts UNION ALL SELECT round(1 - score, 6) FROM alerts",
    "snapshot": "SELECT value FROM base",
    "scorecard": "SELECT count(*) FILTER (detected) FROM results WHERE executed_at < TIMESTAMP '2024-01-17'",
    "scorecard_steps": "SELECT 1 FROM results WHERE executed_at < TIMESTAMP '2024-01-16'",
    "alert_lines": "SELECT 1 FROM base WHERE ts > TIMESTAMP '2024-01-20'",
    "run_files": "SELECT 20240102",
    "log_lines": "SELECT 1 FROM base",
}
_ROUND_TRIPS = " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS n, round(sum(x::DOUBLE), 3) AS total FROM ({sql}) y(x)" for name, sql in _ROUND_TRIP.items()
)
_TRIAGE_ONLY = TRIAGE[TRIAGE.index("rounds AS ("):]
ORACLE["round_trips"] = f"WITH {STEPS}, {_TRIAGE_ONLY} {_ROUND_TRIPS}"
