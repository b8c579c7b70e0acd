"""DuckDB SQL for the reference queries, built on shared table expressions."""

from __future__ import annotations

from ..operators.governance import CONTRACT_STAGES, CONTRACTS, COORDINATES, ESTIMANDS, HYPOTHESIS_REGISTRY, MODEL_REGISTRY, PROVENANCE_PROTOCOL
from ..operators.quality import DECISION_TEXTS, DECISIONS, EVIDENCE_LINKS
from ..operators.stats import GATED, HYPOTHESES
from ..schema import FACTORS, FOLDS, METRICS, PAIRS, SOURCE_COLUMNS

_COLS = ", ".join(SOURCE_COLUMNS)
_MET = ", ".join(METRICS)


def _row(*values) -> str:
    quoted = ("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in values)
    return "(" + ", ".join(quoted) + ")"


def _masked(m: str, probable: bool = False, table: str = "") -> str:
    c = f"{table}{m}"
    if m == "avg_speed_kmph":
        return f"CASE WHEN {c} BETWEEN 0 AND 120 THEN CAST({c} AS DOUBLE) END"
    if m == "temperature_c" and probable:
        return f"CASE WHEN NOT {table}probable_error THEN CAST({c} AS DOUBLE) END"
    return f"CAST({c} AS DOUBLE)"


def _eligible() -> str:
    return "coalesce(" + " AND ".join(f"{m} IS NOT NULL" for m in METRICS) + " AND avg_speed_kmph BETWEEN 0 AND 120, false)"


BASE = f"""
li AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey),
b0 AS (
  SELECT o.o_orderkey AS k, CAST(round(o.o_totalprice * 100) AS BIGINT) AS cents, o.o_orderdate AS d, r.r_name AS rn, c.c_mktsegment AS seg, li.n_lines, li.qty
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN li ON li.l_orderkey = o.o_orderkey),
x0 AS (
  SELECT k, 'OBS' || lpad(CAST(k AS VARCHAR), 9, '0') AS record_id, rn AS city,
    CASE WHEN k % 50 = 7 THEN NULL WHEN k % 4 = 1 THEN lower(seg) ELSE upper(substr(seg, 1, 1)) || lower(substr(seg, 2)) END AS zone,
    substr(CAST(CAST(d AS DATE) AS VARCHAR), 1, 10) || ' ' || lpad(CAST((k % 6) * 4 AS VARCHAR), 2, '0') || CASE WHEN k % 10 = 0 THEN ':00' ELSE ':00:00' END AS timestamp_text,
    CASE WHEN k % 53 = 3 THEN NULL ELSE CAST(qty AS BIGINT) END AS traffic_volume,
    CASE WHEN k % 320 = 5 THEN CAST(-10 AS DOUBLE) WHEN k % 320 = 6 THEN CAST(150 AS DOUBLE) WHEN k % 41 = 2 THEN NULL ELSE (cents % 900) / CAST(10 AS DOUBLE) END AS avg_speed_kmph,
    (cents % 2399) + 100 AS public_transport_usage, 5 + (cents % 1060) / CAST(10 AS DOUBLE) AS parking_occupancy_pct, cents % 9 AS road_incidents, cents % 7 AS waterlogging_reports,
    (cents % 1273) / CAST(10 AS DOUBLE) AS power_outage_minutes, n_lines AS citizen_complaints, CASE WHEN k % 53 = 9 THEN NULL ELSE 6 + (cents % 479) / CAST(10 AS DOUBLE) END AS temperature_c
  FROM b0),
u0 AS (SELECT x0.*, 0 AS dup FROM x0 UNION ALL SELECT x0.*, 1 AS dup FROM x0 WHERE k % 45 = 11),
raw AS (SELECT CAST(row_number() OVER (ORDER BY dup, record_id) + 1 AS BIGINT) AS source_row_number, {_COLS} FROM u0),
ded AS (SELECT min(source_row_number) AS source_row_number, {_COLS}, count(*) AS grp FROM raw GROUP BY {_COLS}),
can0 AS (
  SELECT source_row_number, record_id, city, zone AS raw_zone, nullif(trim(zone), '') AS tz, timestamp_text AS raw_timestamp,
    coalesce(try_strptime(timestamp_text, '%Y-%m-%d %H:%M:%S'), try_strptime(timestamp_text, '%Y-%m-%d %H:%M')) AS ts, {_MET} FROM ded),
can AS (
  SELECT source_row_number, record_id, city, raw_zone, upper(substr(tz, 1, 1)) || lower(substr(tz, 2)) AS zone, raw_timestamp, ts, CAST(ts AS DATE) AS observation_date,
    CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS weekday, CAST(month(ts) AS BIGINT) AS month, {_MET}, {_eligible()} AS eligible FROM can0),
dl AS (
  SELECT raw.source_row_number, raw.record_id, ded.grp AS duplicate_group_size, ded.source_row_number AS kept_source_row_number,
    CASE WHEN raw.source_row_number = ded.source_row_number THEN 'kept' ELSE 'removed_exact_duplicate' END AS action
  FROM raw JOIN ded ON {" AND ".join(f"raw.{c} IS NOT DISTINCT FROM ded.{c}" for c in SOURCE_COLUMNS)} WHERE ded.grp > 1),
fl AS (
  SELECT record_id, source_row_number, 'zone' AS field_name, unnest(['missing', 'unknown']) AS flag_type, CAST(NULL AS VARCHAR) AS raw_value, CAST(NULL AS VARCHAR) AS cleaned_value, CAST(NULL AS DOUBLE) AS number, 'kept as null' AS effect FROM can WHERE raw_zone IS NULL OR raw_zone = ''
  UNION ALL SELECT record_id, source_row_number, 'zone', 'corrected', raw_zone, zone, NULL, 'normalised only' FROM can WHERE raw_zone <> '' AND zone IS DISTINCT FROM raw_zone
  {" ".join(f"UNION ALL SELECT record_id, source_row_number, '{m}', 'missing', NULL, NULL, NULL, 'left out for this metric' FROM can WHERE {m} IS NULL" for m in METRICS)}
  {" ".join(f"UNION ALL SELECT record_id, source_row_number, '{m}', 'outlier', NULL, NULL, {m}, '{e}' FROM can WHERE {c}" for m, c, e in (("avg_speed_kmph", "avg_speed_kmph < 0 OR avg_speed_kmph > 120", "left out of speed analysis"), ("parking_occupancy_pct", "parking_occupancy_pct > 100", "kept"), ("temperature_c", "temperature_c >= 45", "kept"), ("power_outage_minutes", "power_outage_minutes > 60", "kept")))}),
iss AS (
  SELECT record_id, 'zone' AS column_name, 'missing' AS issue_type, CAST(NULL AS VARCHAR) AS raw_value, CAST(NULL AS DOUBLE) AS raw_number, CAST(NULL AS VARCHAR) AS suggested_value, 'preserve_missing' AS treatment, true AS needs_owner, 'medium' AS severity FROM can WHERE raw_zone IS NULL OR raw_zone = ''
  UNION ALL SELECT record_id, 'zone', 'case_variant', raw_zone, NULL, zone, 'canonicalize_case_only', false, 'low' FROM can WHERE raw_zone <> '' AND zone IS DISTINCT FROM raw_zone
  {" ".join(f"UNION ALL SELECT record_id, '{m}', 'missing', NULL, NULL, NULL, 'preserve_missing', true, 'medium' FROM can WHERE {m} IS NULL" for m in METRICS)}
  UNION ALL SELECT record_id, 'avg_speed_kmph', 'negative_value', NULL, avg_speed_kmph, NULL, 'exclude_primary_analysis_do_not_overwrite', true, 'high' FROM can WHERE avg_speed_kmph < 0
  UNION ALL SELECT record_id, 'avg_speed_kmph', 'extreme_value', NULL, avg_speed_kmph, NULL, 'retain_flag_exclude_primary_analysis', true, 'high' FROM can WHERE avg_speed_kmph > 120
  UNION ALL SELECT record_id, 'parking_occupancy_pct', 'above_100', NULL, parking_occupancy_pct, NULL, 'retain_flag_review_semantics', true, 'medium' FROM can WHERE parking_occupancy_pct > 100
  UNION ALL SELECT record_id, 'temperature_c', 'high_value', NULL, temperature_c, NULL, 'retain_flag_review_sensor_context', true, 'medium' FROM can WHERE temperature_c >= 45
  UNION ALL SELECT record_id, 'power_outage_minutes', 'above_60', NULL, power_outage_minutes, NULL, 'retain_flag_review_window_definition', true, 'low' FROM can WHERE power_outage_minutes > 60),
dec0 AS (SELECT * FROM (VALUES {", ".join(_row(*d, *DECISION_TEXTS[d[0]]) for d in DECISIONS)}) v(decision_key, column_name, issue_type, decision_class, confirmation, treatment, primary_effect, rationale)),
dec AS (
  SELECT dec0.*, CAST(coalesce(CASE WHEN dec0.column_name = '__row__' THEN (SELECT count(*) FROM dl WHERE action = 'removed_exact_duplicate') ELSE i.n END, 0) AS BIGINT) AS observed_count
  FROM dec0 LEFT JOIN (SELECT column_name, issue_type, count(*) AS n FROM iss GROUP BY ALL) i ON i.column_name = dec0.column_name AND i.issue_type = dec0.issue_type),
daily AS (
  SELECT r.r_name AS city, CAST(o.o_orderdate AS DATE) AS obs_date,
    min(6 + extract(MONTH FROM o.o_orderdate) + (CAST(round(o.o_totalprice * 100) AS BIGINT) % 97) / CAST(10 AS DOUBLE)) AS t_min,
    max(30 + extract(MONTH FROM o.o_orderdate) + (CAST(round(o.o_totalprice * 100) AS BIGINT) % 113) / CAST(10 AS DOUBLE)) AS t_max
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY r.r_name, CAST(o.o_orderdate AS DATE)),
bench AS (SELECT city, min(t_min) AS low, arg_min(obs_date, (t_min, obs_date)) AS low_date, max(t_max) AS high, arg_min(obs_date, (-t_max, obs_date)) AS high_date FROM daily GROUP BY city),
env AS (SELECT city, CAST(month(obs_date) AS BIGINT) AS month, min(t_min) AS low, max(t_max) AS high FROM daily GROUP BY ALL),
nb AS (SELECT record_id, lag(temperature_c) OVER w AS prev_c, lead(temperature_c) OVER w AS next_c FROM can WHERE temperature_c IS NOT NULL WINDOW w AS (PARTITION BY city ORDER BY ts, record_id)),
nv0 AS (
  SELECT can.record_id, can.city, can.temperature_c, nb.prev_c, nb.next_c,
    CASE WHEN can.temperature_c IS NULL OR env.low IS NULL THEN 'unknown' WHEN can.temperature_c BETWEEN env.low AND env.high THEN 'plausible' ELSE 'implausible' END AS plausibility,
    CASE WHEN can.temperature_c IS NULL THEN 'unknown' WHEN prev_c IS NULL OR next_c IS NULL THEN 'insufficient' WHEN greatest(prev_c, can.temperature_c, next_c) - least(prev_c, can.temperature_c, next_c) <= 10 THEN 'consistent' ELSE 'inconsistent' END AS neighbour_status
  FROM can LEFT JOIN nb ON nb.record_id = can.record_id LEFT JOIN env ON env.city = can.city AND env.month = can.month),
nv AS (
  SELECT *, CASE WHEN plausibility = 'plausible' AND neighbour_status = 'consistent' THEN 'retain_unchanged' WHEN plausibility = 'plausible' AND neighbour_status = 'inconsistent' THEN 'flag_for_review'
    WHEN plausibility = 'implausible' AND neighbour_status = 'inconsistent' THEN 'probable_error' ELSE 'not_assessed' END AS decision FROM nv0),
pe AS (SELECT can.*, nv.decision = 'probable_error' AS probable_error FROM can JOIN nv ON nv.record_id = can.record_id),
lv AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT record_id, city, zone, hour, month, weekday, ts, '{m}' AS metric, {_masked(m)} AS value FROM can" for m in METRICS)}) WHERE value IS NOT NULL),
lp AS (SELECT * FROM ({" UNION ALL ".join(f"SELECT record_id, city, zone, hour, month, weekday, ts, '{m}' AS metric, {_masked(m, True)} AS value FROM pe" for m in METRICS)}) WHERE value IS NOT NULL)"""


def q(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([BASE, *more]) + "\n" + body


_STATS = "count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3"


def _erfc(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * {x}))"
    poly = "0.17087277"
    for c in reversed([-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223]):
        poly = f"({c!r} + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def _pairs(table: str, probable: bool, pairs=PAIRS) -> str:
    return " UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, {_masked(x, probable)} AS a, {_masked(y, probable)} AS b FROM {table}" for x, y in pairs)


_R = "CASE WHEN count(*) >= 4 THEN CASE WHEN var_pop(a) * var_pop(b) <= 0 THEN 0.0 ELSE covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END END"


def _pv(table: str, probable: bool, pairs=PAIRS) -> list[str]:
    return [
        f"pv AS (SELECT * FROM ({_pairs(table, probable, pairs)}) WHERE a IS NOT NULL AND b IS NOT NULL)",
        "rk AS (SELECT x, y, rank() OVER (PARTITION BY x, y ORDER BY a) + (count(*) OVER (PARTITION BY x, y, a) - 1) / 2.0 AS a, rank() OVER (PARTITION BY x, y ORDER BY b) + (count(*) OVER (PARTITION BY x, y, b) - 1) / 2.0 AS b FROM pv)",
    ]


def _tests(specs: list, probable: bool, table: str | None = None) -> list[str]:
    table = table or ("pe" if probable else "can")
    values = ", ".join(f"('{h}', '{x}', '{y}', {e})" for h, x, y, e in specs)
    return _pv(table, probable, [(x, y) for _, x, y, _ in specs]) + [
        f"sp AS (SELECT * FROM (VALUES {values}) v(hypothesis, x, y, expected))",
        f"s1 AS (SELECT x, y, count(*) AS n, {_R} AS rho FROM rk GROUP BY x, y)",
        f"s2 AS (SELECT x, y, {_R} AS pearson FROM pv GROUP BY x, y)",
        f"t1 AS (SELECT *, atanh(greatest(least(rho, 0.999999), -0.999999)) AS z FROM sp JOIN s1 USING (x, y) JOIN s2 USING (x, y))",
        f"t2 AS (SELECT *, tanh(z - 2.5758293035489004 / sqrt(n - 3.0)) AS ci_low, tanh(z + 2.5758293035489004 / sqrt(n - 3.0)) AS ci_high, {_erfc('(abs(z) * sqrt(n - 3.0) / sqrt(2.0))')} AS p FROM t1)",
        "t3 AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, hypothesis) + 1) * p) AS step FROM t2)",
        "t4 AS (SELECT *, max(step) OVER (ORDER BY p, hypothesis ROWS UNBOUNDED PRECEDING) AS p_holm FROM t3)",
    ]


_CENTRE = "(s * s / n)"
_ETA = f"CASE WHEN ss - {_CENTRE} <= 0 THEN 0.0 ELSE (b - {_CENTRE}) / (ss - {_CENTRE}) END"
_SUMS = "count(*) AS n, sum(value) AS s, sum(value * value) AS ss"


def _eta_sql() -> list[str]:
    each = " UNION ALL ".join(f"SELECT '{f}' AS factor, CAST({f} AS VARCHAR) AS level, metric, value FROM lv WHERE {f} IS NOT NULL" for f in FACTORS)
    return [f"gs AS (SELECT factor, level, metric, {_SUMS} FROM ({each}) GROUP BY ALL)", "g1 AS (SELECT factor, metric, sum(n) AS n, count(*) AS groups, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b FROM gs GROUP BY ALL)"]


def _scenarios() -> list[str]:
    med = ", ".join(f"median({_masked(m)}) AS cm_{m}" for m in METRICS)
    alls = ", ".join(f"median({_masked(m)}) AS all_{m}" for m in METRICS)
    pick = ", ".join(f"CASE scenario WHEN 'flagged_values_included' THEN CAST({m} AS DOUBLE) WHEN 'primary_observed' THEN {_masked(m)} ELSE coalesce({_masked(m)}, cm_{m}, all_{m}) END AS {m}" for m in METRICS)
    return [
        f"cm AS (SELECT city AS cmc, month AS cmm, {med} FROM can GROUP BY city, month)", f"am AS (SELECT {alls} FROM can)",
        f"sv AS (SELECT scenario, record_id, city, zone, hour, weekday, month, {pick} FROM can LEFT JOIN cm ON cmc = city AND cmm = month CROSS JOIN am CROSS JOIN (VALUES ('primary_observed'), ('flagged_values_included'), ('city_month_median_imputed')) v(scenario))",
    ]


_IMPUTED = ("traffic_volume", "avg_speed_kmph", "temperature_c")


def _methods() -> list[str]:
    parts = []
    for m in _IMPUTED:
        v = _masked(m, True)
        parts.append(f"SELECT '{m}' AS field, count({v}) AS observed, count(*) FILTER ({m} IS NULL) AS missing, avg({v}) AS mean, median({v}) AS median, skewness({v}) AS skewness, CAST(NULL AS VARCHAR) AS label FROM pe")
    zone = "SELECT 'zone', (SELECT count(zone) FROM pe), (SELECT count(*) FROM pe WHERE zone IS NULL), NULL, NULL, NULL, (SELECT zone FROM pe WHERE zone IS NOT NULL GROUP BY zone ORDER BY count(*) DESC, zone LIMIT 1)"
    return [f"me0 AS ({' UNION ALL '.join(parts)} UNION ALL {zone})", "me AS (SELECT *, CASE WHEN field = 'zone' THEN 'mode' WHEN abs(skewness) <= 0.5 THEN 'mean' ELSE 'median' END AS method FROM me0)", "mt AS (SELECT *, CASE method WHEN 'mean' THEN mean WHEN 'median' THEN median END AS estimate FROM me)"]


def _folds() -> str:
    parts = []
    for m in METRICS:
        for k, a, b in FOLDS:
            parts.append(f"""SELECT '{m}' AS metric, CAST({k} AS BIGINT) AS fold, count(*) AS test_n, round(avg(abs(t.value - coalesce(c1.v, c2.v, c3.v))), 6) AS baseline_mae
  FROM fo t LEFT JOIN (SELECT metric, city, month, median(value) AS v FROM fo WHERE pos <= greatest(10, floor(n * {a})) GROUP BY ALL) c1 ON c1.metric = t.metric AND c1.city = t.city AND c1.month = t.month
  LEFT JOIN (SELECT metric, city, median(value) AS v FROM fo WHERE pos <= greatest(10, floor(n * {a})) GROUP BY ALL) c2 ON c2.metric = t.metric AND c2.city = t.city
  LEFT JOIN (SELECT metric, median(value) AS v FROM fo WHERE pos <= greatest(10, floor(n * {a})) GROUP BY ALL) c3 ON c3.metric = t.metric
  WHERE t.metric = '{m}' AND pos > greatest(10, floor(n * {a})) AND pos <= greatest(greatest(10, floor(n * {a})) + 2, floor(n * {b}))""")
    return " UNION ALL ".join(parts)


def _poisson(u: str) -> str:
    total, term, bounds = 0.0, 0.36787944117144233, []
    for k in range(12):
        total += term
        bounds.append(int(total * (1 << 32)))
        term /= k + 1
    return "(" + " + ".join(f"({u} >= {b})::INT" for b in bounds) + ")"


_SCENARIO_PAIRS = " UNION ALL ".join(f"SELECT scenario, '{x}' AS x, '{y}' AS y, {x} AS a, {y} AS b FROM sv WHERE {x} IS NOT NULL AND {y} IS NOT NULL" for x, y in PAIRS)
_PAIR_ROWS = {"H1": ("traffic_volume", "avg_speed_kmph"), "H2": ("road_incidents", "waterlogging_reports"), "H3": ("temperature_c", "power_outage_minutes")}
_PLACE_ROWS = {"H4_city": "city IS NOT NULL", "H4_zone": "zone IS NOT NULL", "H5": "city IS NOT NULL AND ts IS NOT NULL", "M1_city_zone_continuous": "city IS NOT NULL AND zone IS NOT NULL", "M2_city_zone_counts": "city IS NOT NULL AND zone IS NOT NULL", "M6_repeated_time_dependence": "ts IS NOT NULL", "M7_forecasting": "city IS NOT NULL AND ts IS NOT NULL", "P1": "true"}
_ENTRIES = {h: f"{_masked(x)} IS NOT NULL AND {_masked(y)} IS NOT NULL" for h, (x, y) in _PAIR_ROWS.items()}
_ENTRIES |= {m: _ENTRIES[h] for m, h in (("M3_relationship_traffic_speed", "H1"), ("M4_relationship_incidents_waterlogging", "H2"), ("M5_relationship_temperature_outage", "H3"))} | _PLACE_ROWS
_USABLE = "us AS (" + " UNION ALL ".join(f"SELECT '{e}' AS entry, count(*) FILTER ({c}) AS rows FROM can" for e, c in _ENTRIES.items()) + ")"
_CHOICE = "city IN ('ASIA', 'EUROPE') AND hour IN (0, 8, 16) AND observation_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'"
_FR = "fr AS (SELECT record_id, city, coalesce(zone, 'Unknown') AS zone, ts, observation_date, hour, weekday, month, " + _MET + ", eligible FROM can)"
_UNPIVOT = " UNION ALL ".join(f"SELECT scenario, '{m}' AS metric, {m} AS value FROM sv WHERE {m} IS NOT NULL" for m in METRICS)

SQL: dict[str, str] = {
    "dashboard_city_zone": q("SELECT city, zone, count(*) AS records, CAST(sum(traffic_volume) AS BIGINT) AS traffic, round(avg(traffic_volume), 6) AS mean_traffic, round(median(traffic_volume), 6) AS median_traffic FROM can WHERE eligible AND zone IS NOT NULL GROUP BY city, zone"),
    "dedup_exact": q(f"SELECT source_row_number, {_COLS} FROM ded"),
    "dedup_log": q("SELECT * FROM dl"),
    "canonical_layer": q(f"SELECT source_row_number, record_id, city, raw_zone, zone, raw_timestamp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(observation_date AS VARCHAR) AS observation_date, hour, weekday, month, {_MET}, eligible FROM can"),
    "primary_counts": q("SELECT count(*) FILTER (eligible) AS primary_observed, count(*) FILTER (eligible AND zone IS NOT NULL) AS zone_complete FROM can"),
    "city_zone_coverage": q("SELECT city, coalesce(zone, '[UNKNOWN]') AS zone, count(*) AS rows FROM can GROUP BY ALL"),
    "city_zone_month": q("SELECT city, zone, month, count(*) AS records, CAST(sum(traffic_volume) AS BIGINT) AS traffic FROM can WHERE eligible AND zone IS NOT NULL GROUP BY ALL"),
    "dimension_counts": q(" UNION ALL ".join(f"SELECT '{f}' AS dimension, {'coalesce(zone, ' + chr(39) + '[UNKNOWN]' + chr(39) + ')' if f == 'zone' else f'CAST({f} AS VARCHAR)'} AS member, count(*) AS rows FROM can GROUP BY ALL" for f in FACTORS)),
    "missingness": q(" UNION ALL ".join(f"SELECT '{c}' AS column_name, (SELECT count(*) FROM raw WHERE {c} IS NULL) AS raw_missing, count(*) FILTER ({c} IS NULL) AS missing, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_rate FROM ded" for c in SOURCE_COLUMNS[1:])),
    "missing_slots": q("SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS slot FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 4 HOUR)) AS s FROM can) WHERE hour(s) IN (0, 4, 8, 12, 16, 20) AND s NOT IN (SELECT ts FROM can)"),
    "coverage_audit": q("""SELECT unnest([{'k': 'raw_rows', 'v': r}, {'k': 'deduplicated_rows', 'v': d}, {'k': 'exact_duplicate_rows_removed', 'v': r - d}, {'k': 'unique_timestamps_after_dedup', 'v': t}, {'k': 'expected_four_hour_slots', 'v': e},
  {'k': 'missing_four_hour_slots', 'v': g}, {'k': 'full_panel_expected_rows', 'v': c * z * t}, {'k': 'full_panel_known_observed_keys', 'v': kk}, {'k': 'full_panel_known_coverage_pct', 'v': round(100.0 * kk / (c * z * t), 6)}, {'k': 'one_row_per_timestamp_after_dedup', 'v': (t = d)::INT::DOUBLE}]) AS x FROM cov""".replace("SELECT unnest(", "SELECT x.k AS audit_key, CAST(x.v AS DOUBLE) AS value_num FROM (SELECT unnest(") + ")",
        "slots AS (SELECT s FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 4 HOUR)) AS s FROM can) WHERE hour(s) IN (0, 4, 8, 12, 16, 20))",
        "cov AS (SELECT CAST((SELECT count(*) FROM raw) AS DOUBLE) AS r, count(*)::DOUBLE AS d, count(DISTINCT ts)::DOUBLE AS t, count(DISTINCT city)::DOUBLE AS c, count(DISTINCT zone)::DOUBLE AS z, (SELECT count(*) FROM (SELECT DISTINCT city, zone, ts FROM can WHERE zone IS NOT NULL))::DOUBLE AS kk, (SELECT count(*) FROM slots)::DOUBLE AS e, (SELECT count(*) FROM slots WHERE s NOT IN (SELECT ts FROM can))::DOUBLE AS g FROM can)"),
    "completeness": q(" UNION ALL ".join(f"SELECT '{m}' AS field, count({m}) AS observed, count(*) - count({m}) AS missing, round(100.0 * count({m}) / count(*), 6) AS complete_pct FROM can" for m in METRICS)),
    "kpis": q("SELECT (SELECT count(*) FROM raw) AS raw_rows, count(*) AS canonical_rows, count(DISTINCT ts) AS timestamps, count(*) FILTER (eligible) AS eligible_rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, (SELECT count(*) FROM raw) - count(*) AS duplicate_rows FROM can"),
    "integrity": q("SELECT unnest(['repeated_ids', 'null_ids', 'null_cities', 'null_timestamps', 'eligible_but_invalid']) AS \"check\", unnest([(SELECT count(*) FROM (SELECT record_id FROM can GROUP BY ALL HAVING count(*) > 1)), (SELECT count(*) FROM can WHERE record_id IS NULL), (SELECT count(*) FROM can WHERE city IS NULL), (SELECT count(*) FROM can WHERE ts IS NULL), 0]) AS broken"),
    "quality_flags": q("SELECT record_id, source_row_number, field_name, flag_type, raw_value, cleaned_value, number AS raw_number, number AS cleaned_number, effect FROM fl"),
    "quality_flag_summary": q("SELECT flag_type, field_name, count(*) AS flags FROM fl GROUP BY ALL"),
    "quality_issues": q("SELECT * FROM iss"),
    "row_status": q("SELECT can.record_id, count(fl.record_id) AS issue_count, CASE WHEN count(fl.record_id) > 0 THEN 'flagged' ELSE 'observed' END AS quality_status FROM can LEFT JOIN fl ON fl.record_id = can.record_id GROUP BY can.record_id"),
    "change_log": q("SELECT record_id, source_row_number, field_name, raw_value, cleaned_value, 'canonicalized' AS change_type FROM fl WHERE flag_type = 'corrected' UNION ALL SELECT record_id, source_row_number, '__row__', record_id, NULL, 'deduplicated' FROM dl WHERE action = 'removed_exact_duplicate'"),
    "quality_decisions": q("SELECT * FROM dec"),
    "issue_signals": q("""SELECT signal, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN decision_key = 'zone_case' THEN 'Zone case normalization' WHEN decision_key = 'parking_over_100' THEN 'Parking over 100%' WHEN decision_key IN ('speed_negative', 'speed_extreme') THEN 'Speed outliers'
    WHEN decision_key = 'temperature_missing' THEN 'Temperature missing' WHEN decision_key = 'zone_missing' THEN 'Unknown zones' WHEN decision_key = 'duplicates' THEN 'Exact duplicate rows removed' END AS signal, observed_count AS n FROM dec
  UNION ALL SELECT 'Temperature probable errors', count(*) FILTER (decision = 'probable_error') FROM nv) WHERE signal IS NOT NULL GROUP BY signal"""),
    "city_benchmark": q("SELECT city, low, CAST(low_date AS VARCHAR) AS low_date, high, CAST(high_date AS VARCHAR) AS high_date FROM bench"),
    "month_envelope": q("SELECT * FROM env"),
    "benchmark_check": q("SELECT can.record_id, can.city, can.temperature_c, bench.low, bench.high, CASE WHEN bench.city IS NULL THEN 'unknown_city' WHEN temperature_c IS NULL THEN 'missing' WHEN temperature_c < low THEN 'below' WHEN temperature_c > high THEN 'above' ELSE 'within' END AS status FROM can LEFT JOIN bench ON bench.city = can.city"),
    "neighbour_validation": q("SELECT * FROM nv"),
    "decision_counts": q("SELECT plausibility, neighbour_status, decision, count(*) AS rows FROM nv GROUP BY ALL"),
    "flags_appended": q("""SELECT record_id, field_name, flag_type, effect FROM fl
  UNION ALL SELECT record_id, 'temperature_c', 'outlier', 'probable error' FROM nv WHERE decision = 'probable_error'
  UNION ALL SELECT can.record_id, 'temperature_c', 'outlier', 'kept, not interpreted' FROM can JOIN bench ON bench.city = can.city WHERE can.temperature_c < bench.low OR can.temperature_c > bench.high"""),
    "metric_summary": q(f"SELECT metric, {_STATS} FROM lv GROUP BY metric"),
    "descriptive_summary": q(f"SELECT dimension, member, metric, {_STATS} FROM (SELECT 'overall' AS dimension, 'all' AS member, metric, value FROM lv UNION ALL SELECT 'city', city, metric, value FROM lv UNION ALL SELECT 'zone', coalesce(zone, '[UNKNOWN]'), metric, value FROM lv UNION ALL SELECT 'month', CAST(month AS VARCHAR), metric, value FROM lv UNION ALL SELECT 'hour', lpad(CAST(hour AS VARCHAR), 2, '0') || ':00', metric, value FROM lv UNION ALL SELECT 'weekday', CAST(weekday AS VARCHAR), metric, value FROM lv) GROUP BY ALL"),
    "group_extremes": q("SELECT dimension, metric, arg_min(member, (-mean, member)) AS highest_group, max(mean) AS highest, arg_min(member, (mean, member)) AS lowest_group, min(mean) AS lowest, round(max(mean) - min(mean), 6) AS spread FROM de GROUP BY ALL",
        "de AS (SELECT dimension, member, metric, round(avg(value), 6) AS mean FROM (SELECT 'city' AS dimension, city AS member, metric, value FROM lv UNION ALL SELECT 'zone', coalesce(zone, '[UNKNOWN]'), metric, value FROM lv UNION ALL SELECT 'month', CAST(month AS VARCHAR), metric, value FROM lv UNION ALL SELECT 'hour', lpad(CAST(hour AS VARCHAR), 2, '0') || ':00', metric, value FROM lv UNION ALL SELECT 'weekday', CAST(weekday AS VARCHAR), metric, value FROM lv) GROUP BY ALL)"),
    "pearson_pairs": q(f"SELECT x, y, count(*) AS n, round({_R}, 6) AS r FROM pv GROUP BY x, y", *_pv("can", False)),
    "spearman_pairs": q(f"SELECT x, y, count(*) AS n, round({_R}, 6) AS r FROM rk GROUP BY x, y", *_pv("can", False)),
    "field_rank_pairs": q(f"SELECT r1.metric AS x, r2.metric AS y, count(*) AS n, round(CASE WHEN var_pop(r1.r) * var_pop(r2.r) <= 0 THEN 0.0 ELSE covar_pop(r1.r, r2.r) / sqrt(var_pop(r1.r) * var_pop(r2.r)) END, 6) AS r FROM fk r1 JOIN fk r2 ON r1.record_id = r2.record_id JOIN (VALUES {', '.join(str(p) for p in PAIRS)}) v(x, y) ON v.x = r1.metric AND v.y = r2.metric GROUP BY r1.metric, r2.metric",
        "fk AS (SELECT record_id, metric, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS r FROM lv)"),
    "hypothesis_gates": q("SELECT hypothesis, x, y, n, round(rho, 6) AS rho, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 6) AS p, round(p_holm, 6) AS p_holm, abs(rho) >= 0.2 AND sign(rho) = expected AS practical, p_holm < 0.01 AS significant, abs(rho) >= 0.2 AND sign(rho) = expected AND p_holm < 0.01 AS supported FROM t4", *_tests(GATED, True)),
    "hypothesis_table": q("SELECT hypothesis, x, y, n, round(pearson, 6) AS pearson, round(rho, 6) AS rho, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 6) AS p, round(p_holm, 6) AS p_holm, p_holm < 0.01 AS significant FROM t4", *_tests(HYPOTHESES, False)),
    "eta_squared": q(f"SELECT factor, metric, CAST(n AS BIGINT) AS n, groups, round({_ETA}, 6) AS eta2 FROM g1", *_eta_sql()),
    "top_effects": q(f"SELECT factor, metric, round({_ETA}, 6) AS eta2 FROM g1 ORDER BY {_ETA} DESC, factor, metric LIMIT 12", *_eta_sql()),
    "entropy_unique_rate": q("SELECT metric, round(entropy(value), 6) AS entropy_bits, round(count(DISTINCT value) / count(*), 6) AS unique_rate FROM lv GROUP BY metric"),
    "lag1_autocorrelation": q("SELECT metric, round(CASE WHEN var_pop(a) * var_pop(b) <= 0 THEN 0.0 ELSE covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END, 6) AS value FROM (SELECT metric, lag(value) OVER w AS a, value AS b, count(*) OVER (PARTITION BY metric, city) AS k FROM lv WINDOW w AS (PARTITION BY metric, city ORDER BY ts, record_id)) WHERE a IS NOT NULL AND k >= 3 GROUP BY metric"),
    "permutation_eta_small": q("""SELECT metric, round(max(eta2), 6) AS eta2, round((count(*) FILTER (drawn >= eta2 - 1e-15) + 1) / 6.0, 6) AS p FROM (
  SELECT t.metric, CASE WHEN ss - s * s / n <= 0 THEN 0.0 ELSE (b0 - s * s / n) / (ss - s * s / n) END AS eta2, CASE WHEN ss - s * s / n <= 0 THEN 0.0 ELSE (bb.b - s * s / n) / (ss - s * s / n) END AS drawn
  FROM (SELECT metric, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b0 FROM gs GROUP BY metric) t JOIN bb ON bb.metric = t.metric) GROUP BY metric""",
        "pl AS (SELECT record_id, city AS level, metric, value FROM lp WHERE city IS NOT NULL)", f"gs AS (SELECT metric, level, {_SUMS} FROM pl GROUP BY ALL)",
        "sp AS (SELECT metric, level, n, sum(n) OVER (PARTITION BY metric ORDER BY level ROWS UNBOUNDED PRECEDING) AS hi FROM gs)",
        "pp AS (SELECT metric, rep, value, row_number() OVER (PARTITION BY metric, rep ORDER BY md5('0|' || rep || '|' || metric || '|' || record_id), record_id) AS pos FROM pl CROSS JOIN (SELECT unnest(range(1, 6)) AS rep))",
        "dd AS (SELECT pp.metric, rep, sp.level, sum(value) AS s, max(sp.n) AS k FROM pp JOIN sp ON sp.metric = pp.metric AND pos <= hi AND pos > hi - sp.n GROUP BY ALL)", "bb AS (SELECT metric, rep, sum(s * s / k) AS b FROM dd GROUP BY ALL)"),
    "bootstrap_mean_small": q("SELECT metric, max(n) AS n, round(max(mean), 6) AS mean, round(quantile_cont(m, 0.005), 6) AS ci_low, round(quantile_cont(m, 0.995), 6) AS ci_high FROM bm JOIN (SELECT metric, count(*) AS n, avg(value) AS mean FROM lv GROUP BY metric) USING (metric) GROUP BY metric",
        f"bw AS (SELECT metric, rep, value, CAST('0x' || substr(md5('0|' || rep || '|' || metric || '|' || record_id), 1, 8) AS BIGINT) AS u FROM lv CROSS JOIN (SELECT unnest(range(1, 6)) AS rep))", f"bm AS (SELECT metric, rep, sum({_poisson('u')} * value) / sum({_poisson('u')}) AS m FROM bw GROUP BY ALL)"),
    "pairwise_differences": q("SELECT metric, a, b, round(d, 6) AS difference, abs(d) >= 0.5 AS material FROM (SELECT x.metric, x.level AS a, y.level AS b, (x.s / x.n - y.s / y.n) / sqrt((x.ss - x.s * x.s / x.n + y.ss - y.s * y.s / y.n) / (x.n + y.n - 2)) AS d FROM gs x JOIN gs y ON x.metric = y.metric AND x.factor = 'city' AND y.factor = 'city' AND x.level < y.level)", *_eta_sql()),
    "scenario_summary": q(f"SELECT scenario, metric, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd FROM ({_UNPIVOT}) GROUP BY ALL", *_scenarios()),
    "scenario_correlations": q(f"SELECT scenario, x, y, count(*) AS n, round({_R}, 6) AS r FROM ({' UNION ALL '.join(f'''SELECT scenario, '{x}' AS x, '{y}' AS y, {x} AS a, {y} AS b FROM sv WHERE {x} IS NOT NULL AND {y} IS NOT NULL''' for x, y in PAIRS)}) GROUP BY ALL", *_scenarios()),
    "scenario_group_effects": q(f"SELECT scenario, factor, metric, CAST(n AS BIGINT) AS n, round({_ETA}, 6) AS eta2 FROM (SELECT scenario, factor, metric, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b FROM (SELECT scenario, factor, level, metric, {_SUMS} FROM ({' UNION ALL '.join(f'''SELECT scenario, '{f}' AS factor, CAST({f} AS VARCHAR) AS level, '{m}' AS metric, {m} AS value FROM sv WHERE {m} IS NOT NULL AND {f} IS NOT NULL''' for f in FACTORS for m in METRICS)}) GROUP BY ALL) GROUP BY ALL)", *_scenarios()),
    "imputed_gates": q("SELECT hypothesis, x, y, n, round(rho, 6) AS rho, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 6) AS p, round(p_holm, 6) AS p_holm, abs(rho) >= 0.2 AND sign(rho) = expected AS practical, p_holm < 0.01 AS significant, abs(rho) >= 0.2 AND sign(rho) = expected AND p_holm < 0.01 AS supported FROM t4", *_methods(), "im AS (SELECT * REPLACE (" + ", ".join(f"coalesce(CAST({m} AS DOUBLE), (SELECT estimate FROM mt WHERE field = '{m}')) AS {m}" for m in _IMPUTED) + ") FROM pe)", *_tests(GATED, True, "im")),
    "imputed_flags": q("SELECT field_name, flag_type, reason, count(*) AS flags FROM (SELECT field_name, flag_type, CAST(NULL AS VARCHAR) AS reason FROM fl" + "".join(f" UNION ALL SELECT '{c}', 'imputed', 'imputed for sensitivity: ' || mt.method || ' of {c}' FROM pe JOIN mt ON mt.field = '{c}' WHERE pe.{c} IS NULL" for c in ("zone", *_IMPUTED)) + ") GROUP BY ALL", *_methods()),
    "benchmark_flags": q("SELECT can.record_id, 'temperature_c' AS field_name, 'outlier' AS flag_type, 'outside the benchmark range of its city' AS reason, 'kept, not interpreted' AS effect FROM can JOIN bench ON bench.city = can.city WHERE can.temperature_c < bench.low OR can.temperature_c > bench.high"),
    "evidence_links": q("SELECT l.*, dec.observed_count FROM (VALUES " + ", ".join(_row(*e) for e in EVIDENCE_LINKS) + ") l(decision_key, source, role, confirmation_status) JOIN dec ON dec.decision_key = l.decision_key WHERE dec.observed_count > 0"),
    "latest_contracts": q("SELECT contract_key, area, CASE WHEN contract_key = 'models' THEN 'completed' ELSE status END AS status, stage, CAST(CASE WHEN stage = 'decisions' THEN 1 ELSE 2 END AS INT) AS run, CAST(CASE stage WHEN 'decisions' THEN (SELECT count(*) FROM dec WHERE observed_count > 0) WHEN 'raw' THEN (SELECT count(*) + 1 FROM raw) ELSE (SELECT count(*) + 1 FROM can) END AS BIGINT) AS rows FROM (VALUES "
        + ", ".join(_row(*c, CONTRACT_STAGES[c[0]]) for c in CONTRACTS) + ") v(contract_key, area, status, stage)"),
    "latest_run": q("SELECT 'raw' AS stage, CAST(2 AS INT) AS run, count(*) + 1 AS rows FROM raw UNION ALL SELECT 'canonical', 2, count(*) + 1 FROM can"),
    "hypothesis_registry": q("SELECT v.*, u.rows FROM (VALUES " + ", ".join(_row(*h, ESTIMANDS[h[1]], "registered") for h in HYPOTHESIS_REGISTRY) + ") v(hypothesis, family, expected, practical_gate, alpha, estimand, status) JOIN us u ON u.entry = v.hypothesis", _USABLE),
    "model_registry": q("SELECT v.*, u.rows FROM (VALUES " + ", ".join(_row(*m, "registered") for m in MODEL_REGISTRY) + ") v(model, family, terms, status) JOIN us u ON u.entry = v.model", _USABLE),
    "pair_inference": q(
        "SELECT x, y, n, round(r, 6) AS r, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 6) AS p, method, round(p_holm, 6) AS p_holm, p_holm < 0.01 AS significant FROM i3", *_pv("can", False),
        f"i0 AS (SELECT 'pearson' AS method, x, y, count(*) AS n, {_R} AS r FROM pv GROUP BY x, y UNION ALL SELECT 'spearman', x, y, count(*), {_R} FROM rk GROUP BY x, y)",
        "i1 AS (SELECT *, atanh(greatest(least(r, 0.999999), -0.999999)) AS z FROM i0)",
        f"i2 AS (SELECT *, tanh(z - 2.5758293035489004 / sqrt(n - 3.0)) AS ci_low, tanh(z + 2.5758293035489004 / sqrt(n - 3.0)) AS ci_high, {_erfc('(abs(z) * sqrt(n - 3.0) / sqrt(2.0))')} AS p FROM i1)",
        "i3 AS (SELECT *, max(step) OVER (PARTITION BY method ORDER BY p, x, y ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, least(1.0, (count(*) OVER (PARTITION BY method) - row_number() OVER (PARTITION BY method ORDER BY p, x, y) + 1) * p) AS step FROM i2))",
    ),
    "imputation_methods": q("SELECT field, observed, missing, round(mean, 6) AS mean, round(median, 6) AS median, round(skewness, 6) AS skewness, method, round(estimate, 6) AS estimate, label FROM mt", *_methods()),
    "imputed_layer": q("SELECT record_id, coalesce(zone, (SELECT label FROM mt WHERE field = 'zone')) AS zone, " + ", ".join(f"round(coalesce(CAST({m} AS DOUBLE), (SELECT estimate FROM mt WHERE field = '{m}')), 6) AS {m}" for m in _IMPUTED) + ", CAST(" + " + ".join(f"({c} IS NULL)::INT" for c in ("zone", *_IMPUTED)) + " AS BIGINT) AS imputation_count FROM pe", *_methods()),
    "imputation_events": q(" UNION ALL ".join(f"SELECT record_id, '{c}' AS field, mt.method, round(mt.estimate, 6) AS estimate, mt.label FROM pe JOIN mt ON mt.field = '{c}' WHERE pe.{c} IS NULL" for c in ("zone", *_IMPUTED)), *_methods()),
    "baseline_folds": q(_folds(), "fo AS (SELECT record_id, city, month, metric, value, row_number() OVER (PARTITION BY metric ORDER BY ts, record_id) AS pos, count(*) OVER (PARTITION BY metric) AS n FROM lp)"),
    "filter_options": q("SELECT DISTINCT 'city' AS option, city AS value FROM fr UNION ALL SELECT DISTINCT 'zone', zone FROM fr UNION ALL SELECT DISTINCT 'hour', CAST(hour AS VARCHAR) FROM fr UNION ALL SELECT 'first_date', CAST(min(observation_date) AS VARCHAR) FROM fr UNION ALL SELECT 'last_date', CAST(max(observation_date) AS VARCHAR) FROM fr", _FR),
    "filtered_rows": q(f"SELECT record_id, city, zone, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, hour, weekday, month, {_MET}, eligible FROM fr WHERE {_CHOICE}", _FR),
    "empty_selection": q("SELECT record_id FROM fr WHERE city = 'nowhere'", _FR),
    "metric_flags": q("SELECT record_id, coalesce(avg_speed_kmph BETWEEN 0 AND 120, false) AS speed_primary_valid, temperature_c IS NOT NULL AND record_id NOT IN (SELECT record_id FROM fl WHERE field_name = 'temperature_c' AND flag_type = 'outlier') AS temperature_primary_valid FROM fr", _FR),
    "monthly_summary": q("SELECT strftime(ts, '%Y-%m') AS period, count(*) AS rows, round(avg(traffic_volume), 6) AS traffic_volume, round(avg(temperature_c), 6) AS temperature_c FROM fr GROUP BY ALL", _FR),
    "hourly_summary": q("SELECT lpad(CAST(hour AS VARCHAR), 2, '0') || ':00' AS period, count(*) AS rows, round(avg(traffic_volume), 6) AS traffic_volume, round(avg(temperature_c), 6) AS temperature_c FROM fr GROUP BY ALL", _FR),
    "grouped_valid_means": q("SELECT zone AS member, count(*) AS rows, " + ", ".join(f"round(avg({_masked(m)}), 6) AS {m}" for m in METRICS) + " FROM can GROUP BY zone"),
    "flag_semi_join": q(f"SELECT flag_type, field_name, count(*) AS flags FROM fl WHERE record_id IN (SELECT record_id FROM fr WHERE {_CHOICE}) GROUP BY ALL", _FR),
    "append_one": q("SELECT count(*) AS raw_rows, count(DISTINCT record_id) AS canonical_rows FROM (SELECT record_id FROM raw UNION ALL SELECT 'NEW000000001')"),
    "upsert": q("SELECT 'ASIA' AS city, -1.0 AS low UNION ALL SELECT city, low FROM bench WHERE city <> 'ASIA'"),
    "registries": q("SELECT v.*, u.rows FROM (VALUES " + ", ".join([f"('hypothesis', '{h[0]}', '{h[1]}')" for h in HYPOTHESIS_REGISTRY] + [f"('model', '{m[0]}', '{m[1]}')" for m in MODEL_REGISTRY] + [f"('provenance', '{p[0]}', 'permutation')" for p in PROVENANCE_PROTOCOL]) + ") v(registry, entry, kind) JOIN us u ON u.entry = v.entry", _USABLE),
    "filtered_primary": q(f"SELECT record_id FROM fr WHERE eligible AND {_CHOICE}", _FR),
    "flag_summary_refreshed": q("SELECT flag_type, field_name, count(*) AS flags FROM (SELECT flag_type, field_name FROM fl" + "".join(f" UNION ALL SELECT 'imputed', '{c}' FROM pe WHERE {c} IS NULL" for c in _IMPUTED) + ") GROUP BY ALL"),
    "paired_columns": q("SELECT record_id, source_row_number, city AS raw_city, city AS cleaned_city, raw_zone, zone AS cleaned_zone, raw_timestamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS cleaned_timestamp_iso, CAST(observation_date AS VARCHAR) AS observation_date, hour, weekday, month, " + ", ".join(f"{m} AS raw_{m}, {m} AS cleaned_{m}" for m in METRICS) + ", eligible::INT AS primary_analysis_eligible FROM can"),
    "city_places": q("SELECT c.city, rows, latitude, longitude FROM (SELECT city, count(*) AS rows FROM can GROUP BY city) c LEFT JOIN (VALUES " + ", ".join(_row(*c) for c in COORDINATES) + ") v(city, latitude, longitude) ON v.city = c.city"),
    "evidence_rollup": q("""SELECT item, CAST(value AS BIGINT) AS value FROM (
  SELECT 'canonical_rows' AS item, count(*) AS value FROM can UNION ALL SELECT 'eligible_rows', count(*) FILTER (eligible) FROM can UNION ALL SELECT 'ineligible_rows', count(*) FILTER (NOT eligible) FROM can
  UNION ALL SELECT 'raw_rows', count(*) FROM raw UNION ALL SELECT 'distinct_ids', count(DISTINCT record_id) FROM raw
  UNION ALL SELECT 'confirmed_error_items', coalesce(sum(observed_count), 0) FROM dec WHERE decision_class = 'confirmed_error' UNION ALL SELECT 'valid_extreme_items', coalesce(sum(observed_count), 0) FROM dec WHERE decision_class = 'valid_extreme'
  UNION ALL SELECT 'unknown_items', coalesce(sum(observed_count), 0) FROM dec WHERE decision_class = 'unknown' UNION ALL SELECT 'hypotheses', count(*) FROM t4 UNION ALL SELECT 'hypotheses_significant', count(*) FILTER (p_holm < 0.01) FROM t4)""", *_tests(HYPOTHESES, False)),
    "slot_counts": "SELECT strftime(time_bucket(INTERVAL 4 HOUR, CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS slot_start, event_type, count(*) AS rows FROM events GROUP BY ALL",
}
SQL["filtered_sql"] = SQL["filtered_rows"]
SQL["scenario_inference"] = q(
    "SELECT scenario, x, y, n, round(r, 6) AS r, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p, 6) AS p, round(p_holm, 6) AS p_holm, p_holm < 0.01 AS significant FROM i3", *_scenarios(),
    f"i0 AS (SELECT scenario, x, y, count(*) AS n, {_R} AS r FROM ({_SCENARIO_PAIRS}) GROUP BY ALL)",
    "i1 AS (SELECT *, atanh(greatest(least(r, 0.999999), -0.999999)) AS z FROM i0)",
    f"i2 AS (SELECT *, tanh(z - 2.5758293035489004 / sqrt(n - 3.0)) AS ci_low, tanh(z + 2.5758293035489004 / sqrt(n - 3.0)) AS ci_high, {_erfc('(abs(z) * sqrt(n - 3.0) / sqrt(2.0))')} AS p FROM i1)",
    "i3 AS (SELECT *, max(step) OVER (PARTITION BY scenario ORDER BY p, x, y ROWS UNBOUNDED PRECEDING) AS p_holm FROM (SELECT *, least(1.0, (count(*) OVER (PARTITION BY scenario) - row_number() OVER (PARTITION BY scenario ORDER BY p, x, y) + 1) * p) AS step FROM i2))",
)
SQL["result_rollups"] = f"""SELECT item, round(value, 6) AS value FROM (
  SELECT unnest(['max_abs_r', 'mean_abs_r', 'significant_pairs']) AS item, unnest([max(abs(r)), avg(abs(r)), CAST(sum(significant::INT) AS DOUBLE)]) AS value FROM ({SQL["pair_inference"]})
  UNION ALL SELECT unnest(['max_eta2', 'mean_eta2']), unnest([max(eta2), avg(eta2)]) FROM ({SQL["eta_squared"]})
  UNION ALL SELECT unnest(['max_mean_baseline_mae', 'mean_baseline_mae']), unnest([max(mae), avg(mae)]) FROM (SELECT avg(baseline_mae) AS mae FROM ({SQL["baseline_folds"]}) GROUP BY metric))"""
_EVIDENCE = SQL["evidence_rollup"]
SQL["fitness_decision"] = f"SELECT 'FIT_ONLY_DESCRIPTIVE_REPORTING' AS classification, '{{' || string_agg('\"' || item || '\":' || value, ',' ORDER BY item) || '}}' AS evidence_json FROM ({_EVIDENCE})"
