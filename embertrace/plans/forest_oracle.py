"""The isolation forest as SQL: rows are drawn, trees grown level by level, and walked by recursion."""

from __future__ import annotations

import math

from embertrace import fixed_values as fv
from embertrace.operators.iforest import DRAW_RANGE, OFFERED_ROWS, PATH_STEPS, SAMPLE_ROWS, tree_factors
from embertrace.operators.legacy import LEGACY_TREES
from embertrace.operators.model import GRID, MODEL_NAME
from embertrace.plans import oracle as o

_HEIGHT = math.ceil(math.log2(SAMPLE_ROWS))
_BEFORE, _AFTER = o._BEFORE, o._AFTER


def _hex(text: str, first: int, digits: int) -> str:
    return f"('0x' || substr({text}, {first}, {digits}))::BIGINT"


def forest_ctes(rows: str, width: int, trees: int, seed: int = fv.SEED) -> str:
    """``splits`` and ``leaves`` of the forest grown on ``rows(alert_id, x)``, with ``x`` a list of ``width`` numbers."""
    wanted = trees * OFFERED_ROWS
    far = "CASE WHEN n <= 1 THEN 0.0::DOUBLE WHEN n <= 2 THEN 1.0::DOUBLE ELSE 2 * (ln(n - 1) + 0.5772156649015329::DOUBLE) - 2 * (n - 1)::DOUBLE / n END"
    factors = ", ".join(f"({t}, {f}::BIGINT)" for t, f in enumerate(tree_factors(trees, seed)))
    parts = [
        f"""counted AS (SELECT count(*) AS all_rows, least(count(*), {SAMPLE_ROWS}) AS n FROM {rows})""",
        f"""sized AS MATERIALIZED (
  SELECT all_rows AS n, greatest(1, ceil(log2(greatest(n, 2)))) AS height, greatest({far}, 1e-12::DOUBLE) AS far FROM counted)""",
        f"""pool AS MATERIALIZED (
  SELECT alert_id, x, {_hex('h', 1, 7)} AS a, {_hex('h', 8, 7)} AS b, least(n, {wanted}) AS pool_rows, n
  FROM (SELECT alert_id, x, md5(alert_id || ':{seed}') AS h FROM {rows}), sized
  WHERE n <= {wanted} OR {_hex('h', 15, 7)} < floor({wanted}::DOUBLE / n * {1 << 28}))""",
        f"""offered AS (
  SELECT tree, alert_id, x, (a * factor + b) % {DRAW_RANGE} AS draw, n, pool_rows FROM pool, (VALUES {factors}) f(tree, factor))""",
        f"""s0 AS MATERIALIZED (
  SELECT tree, alert_id, x, 0::BIGINT AS node FROM offered
  WHERE pool_rows <= {OFFERED_ROWS} OR draw < floor({OFFERED_ROWS}::DOUBLE / pool_rows * {DRAW_RANGE})
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY draw, alert_id) <= least({SAMPLE_ROWS}, n))""",
    ]
    ends = lambda f: "[" + ", ".join(f"{f}(x[{i}])" for i in range(1, width + 1)) + "]"
    for d in range(_HEIGHT + 1):
        grows = f"len(can) > 0 AND n > 1 AND {d} < (SELECT height FROM sized)" if d < _HEIGHT else "false"
        parts += [
            f"""c{d} AS MATERIALIZED (
  SELECT *, list_filter(range(1, {width + 1}), lambda i: hi[i] > lo[i]) AS can, md5('{seed}:' || tree || ':' || node) AS h
  FROM (SELECT tree, node, count(*) AS n, {ends('min')} AS lo, {ends('max')} AS hi FROM s{d} GROUP BY tree, node))""",
            f"""l{d} AS MATERIALIZED (
  SELECT tree, node, round(({d} + {far})::DOUBLE * {PATH_STEPS}) / {PATH_STEPS} AS path FROM c{d} WHERE NOT ({grows}))""",
        ]
        if d < _HEIGHT:
            parts += [
                f"""p{d} AS MATERIALIZED (
  SELECT tree, node, f, CASE WHEN middle >= hi[f] THEN lo[f] ELSE middle END AS edge
  FROM (SELECT *, lo[f] + u * (hi[f] - lo[f]) AS middle
    FROM (SELECT *, can[1 + {_hex('h', 1, 13)} % len(can)] AS f, {_hex('h', 14, 13)} / {1 << 52}::DOUBLE AS u FROM c{d} WHERE {grows})))""",
                f"""s{d + 1} AS MATERIALIZED (
  SELECT s.tree, s.alert_id, s.x, 2 * s.node + 1 + (s.x[p.f] > p.edge)::BIGINT AS node
  FROM s{d} s JOIN p{d} p ON p.tree = s.tree AND p.node = s.node)""",
            ]
    union = lambda letter, n: " UNION ALL ".join(f"SELECT * FROM {letter}{d}" for d in range(n))
    parts += [f"splits AS MATERIALIZED ({union('p', _HEIGHT)})", f"leaves AS MATERIALIZED ({union('l', _HEIGHT + 1)})"]
    return ",\n".join(parts)


def walk_ctes(rows: str, trees: int, name: str) -> str:
    """``name(alert_id, x, total, raw)``: every row of ``rows`` walked down all trees."""
    return f"""
{name}_at AS (
  SELECT alert_id, tree, 0::BIGINT AS node FROM {rows}, range({trees}) t(tree)
  UNION ALL
  SELECT w.alert_id, w.tree, 2 * w.node + 1 + (r.x[s.f] > s.edge)::BIGINT
  FROM {name}_at w JOIN splits s ON s.tree = w.tree AND s.node = w.node JOIN {rows} r ON r.alert_id = w.alert_id
),
{name} AS MATERIALIZED (
  SELECT r.alert_id, r.x, w.total, -pow(2.0::DOUBLE, -w.total / ({trees} * (SELECT far FROM sized))) AS raw
  FROM {rows} r JOIN (SELECT a.alert_id, sum(l.path) AS total FROM {name}_at a JOIN leaves l ON l.tree = a.tree AND l.node = a.node GROUP BY a.alert_id) w
    ON w.alert_id = r.alert_id)"""


def _scaled(name: str, feats: str, stats: str) -> str:
    x = ", ".join(f"({f} - m_{f}) / s_{f}" for f in fv.FEATURES)
    return f"{name} AS MATERIALIZED (SELECT alert_id, [{x}] AS x FROM {feats}, {stats})"


def _stats(name: str, feats: str) -> str:
    parts = ", ".join(
        f"avg({f}) AS m_{f}, CASE WHEN min({f}) = max({f}) THEN 1.0::DOUBLE ELSE stddev_pop({f}) END AS s_{f}" for f in fv.FEATURES
    )
    return f"{name} AS MATERIALIZED (SELECT {parts} FROM {feats})"


_NAMES = "[" + ", ".join(f"'{f}'" for f in fv.FEATURES) + "]"
_TOP = (
    f"array_to_string(list_transform(list_reverse_sort(list_transform(range(1, {len(fv.FEATURES) + 1}), "
    f"lambda i: {{'size': abs(x[i]), 'i': i}}))[1:3], lambda s: {_NAMES}[s.i]), ',')"
)


def _report(rows: str, lo: str, hi: str, cut: str, percentile: str, raw: str = "raw") -> str:
    """The columns of the scores table; the percentile is rounded as a decimal number."""
    score = f"(1 - ({raw} - {lo}) / ({hi} - {lo} + {fv.SCORE_EPSILON!r}::DOUBLE))"
    return f"""
SELECT alert_id, round({score}, 6) AS anomaly_score, round(({percentile})::VARCHAR::DECIMAL(30, 18), 2)::DOUBLE AS anomaly_percentile,
  raw < {cut} AS is_anomaly,
  CASE WHEN NOT raw < {cut} THEN 'auto-close' WHEN {score} >= {fv.TIER1_SCORE} THEN 'tier-1' ELSE 'tier-2' END AS routing_decision,
  '{MODEL_NAME}' AS model, {_TOP} AS top_features
FROM {rows}"""


_BATCH_RANKS = """ranked AS (
  SELECT *, rank() OVER (ORDER BY total DESC) - 1 AS above, count(*) OVER (PARTITION BY total) AS ties, count(*) OVER () AS n,
    min(raw) OVER () AS lo, max(raw) OVER () AS hi FROM scored)"""
_BATCH_PERCENTILE = "(above + (ties + 1) / 2.0::DOUBLE) / n * 100"
_N = len(fv.FEATURES)

_TRAINED = (
    o.FEATURES
    + f",\n{_stats('scaler', 'feats')},\n{_scaled('x_rows', 'feats', 'scaler')},\n"
    + forest_ctes("x_rows", _N, fv.TREES)
)

ORACLE: dict[str, str] = {}

ORACLE["forest_slots"] = f"""
WITH RECURSIVE {_TRAINED}
SELECT tree::INT AS tree, node::INT AS node, {_NAMES}[f] AS feature, round(edge, 6) + 0.0::DOUBLE AS threshold, NULL::DOUBLE AS path FROM splits
UNION ALL SELECT tree::INT, node::INT, NULL, NULL, round(path, 6) FROM leaves"""

ORACLE["forest_walk"] = f"""
WITH RECURSIVE {_TRAINED}, {walk_ctes('x_rows', fv.TREES, 'scored')}
SELECT alert_id, round(total, 6) AS total_path, round(raw, 9) AS raw FROM scored"""

ORACLE["iforest_scores"] = f"""
WITH RECURSIVE {_TRAINED}, {walk_ctes('x_rows', fv.TREES, 'scored')}, {_BATCH_RANKS},
cut_off AS (SELECT quantile_cont(raw, {fv.CONTAMINATION}) AS edge FROM scored)
{_report('ranked', 'lo', 'hi', '(SELECT edge FROM cut_off)', _BATCH_PERCENTILE)}"""

_SPLIT = (
    f"{o.BASE},{o._CMD},{o._feature_ctes('old_feats', _BEFORE)},\n{_stats('scaler', 'old_feats')},\n"
    f"{_scaled('old_rows', 'old_feats', 'scaler')},\n{forest_ctes('old_rows', _N, fv.TREES)},\n"
    f"{walk_ctes('old_rows', fv.TREES, 'old_scored')},\n"
    f"cut_off AS MATERIALIZED (SELECT quantile_cont(raw, {fv.CONTAMINATION}) AS edge, min(raw) AS lo, max(raw) AS hi FROM old_scored)"
)

ORACLE["incremental_batch"] = f"""
WITH RECURSIVE {_SPLIT}, {o._feature_ctes('new_feats', _AFTER)}, {_scaled('new_rows', 'new_feats', 'scaler')},
{walk_ctes('new_rows', fv.TREES, 'scored')}, {_BATCH_RANKS}
{_report('ranked', 'lo', 'hi', '(SELECT edge FROM cut_off)', _BATCH_PERCENTILE)}"""


def _seen(*keys: str) -> str:
    """Rarity of a key by what was there before: a key that was not gets the highest."""
    same = " AND ".join(f"b.{k} = a.{k}" for k in keys)
    null = " OR ".join(f"a.{k} IS NULL" for k in keys[:1])
    count = f"(SELECT count(*) FROM before b WHERE {same})"
    return f"CASE WHEN {null} THEN 0::DOUBLE ELSE ln(1 + (SELECT count(*) FROM before)::DOUBLE / greatest({count}, 1)) END"


_KNOWN = f"""
before AS MATERIALIZED (SELECT proc, parent, user_name, host, cat FROM sec WHERE {_BEFORE}),
new_feats AS (
  SELECT alert_id, ({o._rank('cat', fv.CATEGORY_RANK)})::DOUBLE AS event_category_rank,
    ({o._rank('channel', fv.CHANNEL_RANK)})::DOUBLE AS channel_rank, k::DOUBLE AS event_id,
    {_seen('proc')} AS proc_rarity, {_seen('parent')} AS parent_proc_rarity, {_seen('parent', 'proc')} AS parent_child_rarity,
    {_seen('user_name')} AS user_rarity, {_seen('host', 'cat')} AS host_event_rarity,
    has_cmd, cmd_len, cmd_has_encoding, cmd_has_download, hour(ts)::DOUBLE AS hour
  FROM sec a LEFT JOIN cmd ON doc_id = a.event_id % (SELECT count(*) FROM documents) WHERE {_AFTER})"""

ORACLE["iforest_incremental"] = f"""
WITH RECURSIVE {_SPLIT}, {_KNOWN}, {_scaled('new_rows', 'new_feats', 'scaler')}, {walk_ctes('new_rows', fv.TREES, 'scored')},
running AS (SELECT total, row_number() OVER (ORDER BY total) AS place, count(*) OVER () AS n FROM old_scored),
grid AS MATERIALIZED (
  SELECT step, min(total) AS total FROM running, range({GRID + 1}) g(step) WHERE place * {GRID} >= step * n GROUP BY step),
placed AS (
  SELECT s.*, least(greatest(raw, c.lo), c.hi) AS inside, c.lo, c.hi, (SELECT count(*) FROM grid g WHERE g.total > s.total) AS above
  FROM scored s, cut_off c)
{_report('placed', 'lo', 'hi', '(SELECT edge FROM cut_off)', f'least(above * 100.0::DOUBLE / {GRID}, 100.0)', 'inside')}"""

_CODE = ("event_type_code", "source_ip_code")
_AXES = ", ".join(f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1)" for c in _CODE)
ORACLE["legacy_scores"] = f"""
WITH RECURSIVE {o.LEGACY}, x_rows AS MATERIALIZED (SELECT alert_id, [{_AXES}] AS x FROM coded),
{forest_ctes('x_rows', 2, LEGACY_TREES)}, {walk_ctes('x_rows', LEGACY_TREES, 'scored')}
SELECT alert_id, round(1 - (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + {fv.SCORE_EPSILON!r}::DOUBLE), 6) AS anomaly_score,
  'isolation_forest' AS model FROM scored"""


def _legacy_run(run: str, until: str) -> str:
    """The rows of one run of the legacy job, as a query of its own."""
    inside = f"ts BETWEEN TIMESTAMP '{until}' - INTERVAL 36 HOUR AND TIMESTAMP '{until}'"
    rows = o.LEGACY.replace("AS source_ip FROM events", f"AS source_ip, ts FROM events WHERE {inside}")
    coded = rows.replace("AS source_ip_code FROM rows_in", "AS source_ip_code, ts FROM rows_in")
    return f"""
SELECT '{run}' AS run_id, alert_id, {o._TS.format('ts')} AS timestamp, anomaly_score, model AS method FROM (
WITH RECURSIVE {coded}, x_rows AS MATERIALIZED (SELECT alert_id, [{_AXES}] AS x FROM coded),
{forest_ctes('x_rows', 2, LEGACY_TREES)}, {walk_ctes('x_rows', LEGACY_TREES, 'scored')}
SELECT s.alert_id, c.ts, round(1 - (raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER () + {fv.SCORE_EPSILON!r}::DOUBLE), 6) AS anomaly_score,
  'isolation_forest' AS model FROM scored s JOIN coded c ON c.alert_id = s.alert_id)"""


ORACLE["legacy_job"] = f"{_legacy_run('a', '2024-01-10')} UNION ALL {_legacy_run('b', '2024-01-12')}"

ORACLE["stored_run"] = f"""
WITH RECURSIVE {_TRAINED}, {walk_ctes('x_rows', fv.TREES, 'scored')}
SELECT 'scores' AS part, count(*) AS n FROM events
UNION ALL SELECT 'feature_snapshot', count(*) FROM events
UNION ALL SELECT 'anomalies', count(*) FROM scored WHERE raw < (SELECT quantile_cont(raw, {fv.CONTAMINATION}) FROM scored)
UNION ALL SELECT 'run_metrics', 12 UNION ALL SELECT 'run_ledger', 2 UNION ALL SELECT 'trees', {fv.TREES}
UNION ALL SELECT 'frequencies', count(*) FROM ({o.ORACLE['freq_tables']})"""
