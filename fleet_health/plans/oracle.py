"""The registered queries in DuckDB SQL, for checking results. Written independently of Spark."""

from __future__ import annotations

from fleet_health.plans.views import FAILURE_MODES
from fleet_health.schema import DYNAMIC_FEATURES, STATIC_FEATURES

KEY = "TERMINAL_CODE, EXECUTION_TIME"


def _half_up(x: str, digits: int) -> str:
    """Round the shortest decimal form of a double, ties away from zero."""
    return f"CAST(ROUND(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


# Hours come from whole microseconds by one division, so exact ties occur and must round alike.
_TIES = {"os_uptime_hours", "db_uptime_hours", "log_exist_hours"}


def _r(name: str, digits: int = 6) -> str:
    if name in _TIES:
        return f"{_half_up(name, digits)} + 0.0 AS {name}"
    return f"ROUND(CAST({name} AS DOUBLE), {digits}) + 0.0 AS {name}"


def _rs(names, digits: int = 6) -> str:
    return ", ".join(_r(n, digits) for n in names)


def _feature_rounds() -> str:
    return ", ".join(_r(c, 7 if "roll_mean" in c else 6) for c in DYNAMIC_FEATURES)


_MODES = ", ".join(f"'{m}'" for m in FAILURE_MODES)

# Views, in order of use. Unused ones cost nothing.
VIEWS = {
    "v_static": """
SELECT printf('TC%06d', c_custkey) AS TERMINAL_CODE, CAST(c_custkey % 3 + 1 AS INTEGER) AS TERMINAL_TYPE_ID,
       CASE WHEN c_custkey % 40 = 39 THEN NULL ELSE c_mktsegment END AS PLATFORM,
       n_name AS PLATFORM_VER, r_name AS ASA_VERSION, CAST(4096 AS BIGINT) AS DB_PAGE_SIZE,
       50000 + c_custkey * 10 AS ODBC_FILE_SIZE_B, 8000000 + c_custkey * 1000 AS CLIENT_EXE_SIZE_B,
       600 + abs(c_acctbal) AS HOME_TOTAL_MB, 300 + abs(c_acctbal) / 2 AS HOME1_TOTAL_MB,
       TIMESTAMP '2024-01-01 00:00:00' AS EXECUTION_TIME, c_custkey AS k
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE c_custkey % 50 <> 49 AND c_custkey IN (SELECT user_id FROM events)""",
    "v_dynamic": """
SELECT printf('TC%06d', user_id) AS TERMINAL_CODE, ts AS EXECUTION_TIME, event_id,
       CASE WHEN event_type = 'view' THEN 'n/a' ELSE regexp_extract(props, '([0-9]+)', 1) END AS LAST_TKT_NUMBER,
       event_id % 150 AS TOTAL_TKT_ISSUED_YESTERDAY, event_id % 120 AS TOTAL_TKT_ISSUED_TODAY,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS NETWORK_LINK,
       "value" AS HOME_USED_MB, "value" / 2 AS HOME1_USED_MB, "value" * 2 AS DB_FILE_SIZE_MB,
       event_id % 5000 AS DB_FILE_SIZE_IN_PAGES, (event_id * 7) % 3000 AS DB_FREE_PAGES,
       "value" / 10 AS DB_MRR_LOG_DIR_SIZE_MB, "value" / 20 AS DB_CRASH_LOG_DIR_SIZE_MB,
       ts - to_days(CAST(event_id % 60 AS INTEGER)) AS OS_UP_SINCE,
       ts - to_days(CAST(event_id % 30 AS INTEGER)) AS DB_UP_SINCE,
       ts - to_days(CAST(event_id % 14 AS INTEGER)) AS CLIENT_LOG_EXIST_SINCE, event_type AS TC_MAKE
FROM events""",
    "v_degradation": f"""
SELECT TERMINAL_CODE, list_extract([{_MODES}], CAST((k // 7) % 6 + 1 AS INTEGER)) AS failure_mode,
       CAST(5 + k % 20 AS INTEGER) AS days_to_failure,
       TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(1 + k % 5 AS INTEGER)) AS failure_date,
       TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(1 + k % 5 AS INTEGER))
         - to_days(CAST(5 + k % 20 AS INTEGER)) AS start_of_degradation
FROM v_static WHERE k % 7 = 0""",
    "v_labels": f"""
SELECT d.TERMINAL_CODE, d.EXECUTION_TIME,
       CASE WHEN d.EXECUTION_TIME >= g.start_of_degradation THEN 1 ELSE 0 END AS fault_label,
       CASE WHEN d.EXECUTION_TIME >= g.start_of_degradation
            THEN {_half_up("greatest(0.0, date_diff('microsecond', d.EXECUTION_TIME, g.failure_date) / 8.64e10)", 4)}
            ELSE -1.0 END AS rul_days,
       COALESCE(g.failure_mode, 'none') AS failure_mode
FROM v_dynamic d JOIN v_static s ON d.TERMINAL_CODE = s.TERMINAL_CODE
LEFT JOIN v_degradation g ON d.TERMINAL_CODE = g.TERMINAL_CODE""",
    "v_now": "SELECT max(EXECUTION_TIME) AS now_ref FROM v_dynamic",
    "v_islands": f"""
SELECT *, sum(CASE WHEN NETWORK_LINK <> 1 THEN 1 ELSE 0 END) OVER w AS island,
       row_number() OVER w AS rn, count(*) OVER (PARTITION BY TERMINAL_CODE) AS n_rows
FROM v_dynamic WINDOW w AS (PARTITION BY TERMINAL_CODE ORDER BY EXECUTION_TIME, event_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "v_feat": """
SELECT d.*,
  CAST(trunc(COALESCE(TRY_CAST(LAST_TKT_NUMBER AS DOUBLE), 0)) AS BIGINT) AS LAST_TKT_NUMBER_int,
  sin(2 * pi() * hour(d.EXECUTION_TIME) / 24) AS hour_sin,
  cos(2 * pi() * hour(d.EXECUTION_TIME) / 24) AS hour_cos,
  sin(2 * pi() * (isodow(d.EXECUTION_TIME) - 1) / 7) AS day_of_week_sin,
  cos(2 * pi() * (isodow(d.EXECUTION_TIME) - 1) / 7) AS day_of_week_cos,
  CASE WHEN s.TERMINAL_CODE IS NULL THEN 0.0 ELSE HOME_USED_MB / s.HOME_TOTAL_MB * 100 END AS home_used_pct,
  CASE WHEN s.TERMINAL_CODE IS NULL THEN 0.0 ELSE HOME1_USED_MB / s.HOME1_TOTAL_MB * 100 END AS home1_used_pct,
  CASE WHEN DB_FILE_SIZE_IN_PAGES > 0 THEN DB_FREE_PAGES / DB_FILE_SIZE_IN_PAGES * 100 ELSE 0.0 END AS db_free_pct,
  date_diff('microsecond', OS_UP_SINCE, now_ref) / 3.6e9 AS os_uptime_hours,
  date_diff('microsecond', DB_UP_SINCE, now_ref) / 3.6e9 AS db_uptime_hours,
  date_diff('microsecond', CLIENT_LOG_EXIST_SINCE, now_ref) / 3.6e9 AS log_exist_hours,
  CASE WHEN TOTAL_TKT_ISSUED_YESTERDAY > 0
       THEN TOTAL_TKT_ISSUED_TODAY / TOTAL_TKT_ISSUED_YESTERDAY ELSE 0.0 END AS ticket_volume_ratio,
  avg(HOME_USED_MB) OVER r AS home_used_roll_mean_12,
  COALESCE(stddev_samp(HOME_USED_MB) OVER r, 0.0) AS home_used_roll_std_12,
  avg(DB_FREE_PAGES) OVER r AS db_free_roll_mean_12,
  COALESCE(stddev_samp(DB_FREE_PAGES) OVER r, 0.0) AS db_free_roll_std_12,
  avg(DB_MRR_LOG_DIR_SIZE_MB) OVER r AS mrr_log_roll_mean_12,
  avg(DB_CRASH_LOG_DIR_SIZE_MB) OVER r AS crash_log_roll_mean_12,
  COALESCE(HOME_USED_MB - lag(HOME_USED_MB) OVER o, 0.0) AS home_used_diff,
  COALESCE(DB_FREE_PAGES - lag(DB_FREE_PAGES) OVER o, 0) AS db_free_diff,
  sum(CASE WHEN NETWORK_LINK = 1 THEN 1 ELSE 0 END) OVER
    (PARTITION BY d.TERMINAL_CODE, island ORDER BY rn ROWS UNBOUNDED PRECEDING) AS netlink_stable_hours,
  (HOME_USED_MB - avg(HOME_USED_MB) OVER m) /
    CASE WHEN stddev_samp(HOME_USED_MB) OVER m = 0 THEN 1 ELSE stddev_samp(HOME_USED_MB) OVER m END AS home_used_zscore,
  (DB_FREE_PAGES - avg(DB_FREE_PAGES) OVER m) /
    CASE WHEN stddev_samp(DB_FREE_PAGES) OVER m = 0 THEN 1 ELSE stddev_samp(DB_FREE_PAGES) OVER m END AS db_free_zscore
FROM v_islands d CROSS JOIN v_now LEFT JOIN v_static s ON d.TERMINAL_CODE = s.TERMINAL_CODE
WINDOW o AS (PARTITION BY d.TERMINAL_CODE ORDER BY rn),
       r AS (PARTITION BY d.TERMINAL_CODE ORDER BY rn ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
       m AS (PARTITION BY d.TERMINAL_CODE)""",
    "v_codes_p": "SELECT PLATFORM, row_number() OVER (ORDER BY PLATFORM) - 1 AS c FROM (SELECT DISTINCT PLATFORM FROM v_static WHERE PLATFORM IS NOT NULL)",
    "v_codes_a": "SELECT ASA_VERSION, row_number() OVER (ORDER BY ASA_VERSION) - 1 AS c FROM (SELECT DISTINCT ASA_VERSION FROM v_static WHERE ASA_VERSION IS NOT NULL)",
    "v_sfeat": """
SELECT s.*, CAST(COALESCE(p.c, -1) AS INTEGER) AS PLATFORM_enc, CAST(COALESCE(a.c, -1) AS INTEGER) AS ASA_VERSION_enc
FROM v_static s LEFT JOIN v_codes_p p ON s.PLATFORM = p.PLATFORM LEFT JOIN v_codes_a a ON s.ASA_VERSION = a.ASA_VERSION""",
    "v_windows": """
SELECT TERMINAL_CODE, window_no FROM (
  SELECT TERMINAL_CODE, n_rows, unnest(range(0, (n_rows - 24) // 8 + 1)) AS window_no
  FROM (SELECT DISTINCT TERMINAL_CODE, n_rows FROM v_islands WHERE n_rows >= 24))""",
    "v_index": """
SELECT w.TERMINAL_CODE, w.window_no, a.EXECUTION_TIME AS start_time, b.EXECUTION_TIME AS target_time
FROM v_windows w JOIN v_islands a ON a.TERMINAL_CODE = w.TERMINAL_CODE AND a.rn = w.window_no * 8 + 1
JOIN v_islands b ON b.TERMINAL_CODE = w.TERMINAL_CODE AND b.rn = w.window_no * 8 + 24""",
    "v_lindex": """
SELECT i.*, l.fault_label, l.rul_days FROM v_index i
JOIN v_static s ON s.TERMINAL_CODE = i.TERMINAL_CODE
JOIN v_labels l ON l.TERMINAL_CODE = i.TERMINAL_CODE AND l.EXECUTION_TIME = i.target_time""",
    "v_split": """
SELECT *, row_number() OVER (PARTITION BY fault_label ORDER BY h) <= (count(*) OVER (PARTITION BY fault_label) + 4) // 5 AS is_test
FROM (SELECT *, md5(TERMINAL_CODE || '|' || window_no || '|42') AS h FROM v_lindex)""",
    "v_scored": f"""
SELECT l.TERMINAL_CODE, l.EXECUTION_TIME, fault_label AS y_true,
       {_half_up("1 / (1 + exp(0.0 - (HOME_USED_MB - 50) / 25))", 4)} AS prob,
       rul_days AS rul_true, 0.0::DOUBLE AS l0, (HOME_USED_MB - 50) / 25 AS l1,
       (1.0::DOUBLE - {_half_up("1 / (1 + exp(0.0 - (HOME_USED_MB - 50) / 25))", 4)}) * 30 AS rul_pred
FROM v_labels l JOIN v_dynamic d ON l.TERMINAL_CODE = d.TERMINAL_CODE AND l.EXECUTION_TIME = d.EXECUTION_TIME""",
    "v_newest": """
SELECT TERMINAL_CODE, max(EXECUTION_TIME) AS EXECUTION_TIME, avg(HOME_USED_MB) AS used,
       max(CASE WHEN rn = n_rows THEN netlink_stable_hours END) AS stable
FROM v_feat WHERE rn > n_rows - 24 AND n_rows >= 24 GROUP BY TERMINAL_CODE""",
    "v_predictions": f"""
SELECT TERMINAL_CODE, EXECUTION_TIME, {_half_up("p", 4)} AS fault_probability,
       {_half_up("greatest(30 * (1 - p), 0)", 2)} AS predicted_rul_days, p > 0.5 AS is_fault_risk
FROM (SELECT *, 1 / (1 + exp(-(0.05 * used - 0.03 * stable - 2))) AS p FROM v_newest
      WHERE TERMINAL_CODE IN (SELECT TERMINAL_CODE FROM v_static))""",
    "v_metro": """
SELECT event_id AS idx, ts, "value" / 10 AS TP2, "value" / 20 AS TP3, "value" / 50 AS Reservoirs,
       50 + "value" / 10 AS Oil, "value" / 100 AS Motor, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS COMP,
       "value" / 30 AS LPS, printf('%d_W%02d', isoyear(ts), weekofyear(ts)) AS TERMINAL_CODE
FROM events""",
    "v_ai4i": """
SELECT printf('TC%05d', p_partkey + 1) AS TERMINAL_CODE,
       CASE p_size % 3 WHEN 0 THEN 'H' WHEN 1 THEN 'L' ELSE 'M' END AS kind,
       295 + p_size / 10 AS air, 305 + p_size / 10 AS process, 1200 + p_partkey % 1500 AS speed,
       CAST(20 + p_size AS DOUBLE) AS torque, p_partkey % 250 AS wear,
       CASE WHEN p_partkey % 29 = 0 THEN 1 ELSE 0 END AS failed,
       CASE WHEN p_partkey % 29 = 0 THEN (p_partkey // 29) % 6 ELSE 5 END AS mode
FROM part""",
    "v_hourly": """
SELECT *, TIMESTAMP '2020-06-01 06:00:00' + to_hours(step) AS EXECUTION_TIME,
       CASE WHEN failed = 1 AND step > 20 THEN step - 20 ELSE 0 END AS late
FROM v_ai4i, (SELECT CAST(unnest(range(24)) AS INTEGER) AS step)""",
    "v_metro_static": """
SELECT TERMINAL_CODE, 1 AS TERMINAL_TYPE_ID, 'MetroPT3' AS PLATFORM, '1.0' AS PLATFORM_VER,
       '17.0.0.0' AS ASA_VERSION, '1252LATIN1' AS DEFAULT_COLLATION, CAST(4096 AS BIGINT) AS DB_PAGE_SIZE,
       CAST(100000 AS BIGINT) AS ODBC_FILE_SIZE_B, CAST(12000000 AS BIGINT) AS CLIENT_EXE_SIZE_B,
       CAST(5000.0 AS DOUBLE) AS HOME_TOTAL_MB, CAST(2000.0 AS DOUBLE) AS HOME1_TOTAL_MB, min(ts) AS EXECUTION_TIME
FROM v_metro GROUP BY TERMINAL_CODE""",
    "v_ai4i_static": """
SELECT TERMINAL_CODE, CASE kind WHEN 'H' THEN 1 WHEN 'L' THEN 2 ELSE 3 END AS TERMINAL_TYPE_ID, 'AI4I' AS PLATFORM,
       '2020' AS PLATFORM_VER, '17.0.0.0' AS ASA_VERSION, '1252LATIN1' AS DEFAULT_COLLATION,
       CAST(4096 AS BIGINT) AS DB_PAGE_SIZE, CAST(100000 AS BIGINT) AS ODBC_FILE_SIZE_B,
       CAST(12000000 AS BIGINT) AS CLIENT_EXE_SIZE_B, CAST(5000.0 AS DOUBLE) AS HOME_TOTAL_MB,
       CAST(2000.0 AS DOUBLE) AS HOME1_TOTAL_MB, TIMESTAMP '2020-01-01 00:00:00' AS EXECUTION_TIME
FROM v_ai4i""",
    "v_history": f"""
SELECT epoch, {_half_up("avg(v) / 100", 4)} AS train_loss,
       {_half_up("1.0::DOUBLE - CAST(sum(CASE WHEN y <> a THEN 1 ELSE 0 END) AS DOUBLE) / count(*)", 4)} AS val_fault_accuracy,
       {_half_up("2.0::DOUBLE * sum(CASE WHEN y AND a THEN 1 ELSE 0 END) / (2 * sum(CASE WHEN y AND a THEN 1 ELSE 0 END) + sum(CASE WHEN y <> a THEN 1 ELSE 0 END))", 4)} AS val_fault_f1,
       CASE WHEN epoch <> 4 THEN {_half_up("avg(abs(v - 50)) / 10", 4)} END AS val_rul_mae
FROM (SELECT CAST(event_id % 5 + 1 AS INTEGER) AS epoch, "value" AS v, event_type = 'error' AS y,
             "value" > 50 AND event_id % 5 > 0 AS a FROM events) GROUP BY epoch""",
    "v_configs": """
SELECT CASE WHEN p_size % 8 = 0 THEN 'model_quick' ELSE 'model_' || (p_size % 8) END AS name, p_size % 8 AS nr,
       count(*) AS num_machines, min(p_size) AS seq_len, max(p_retailprice) AS rul_max
FROM part GROUP BY ALL""",
    "v_metrics": """
SELECT (tp + tn) / n AS fault_accuracy,
       CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS fault_precision,
       CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS fault_recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS fault_f1,
       COALESCE(mae, 0) AS rul_mae, COALESCE(sqrt(mse), 0) AS rul_rmse, tn, fp, fn, tp
FROM (SELECT count(*) AS n,
        count(*) FILTER (y_true = 1 AND prob > 0.5) AS tp, count(*) FILTER (y_true = 0 AND prob > 0.5) AS fp,
        count(*) FILTER (y_true = 1 AND prob <= 0.5) AS fn, count(*) FILTER (y_true = 0 AND prob <= 0.5) AS tn,
        avg(abs(rul_true - rul_pred)) FILTER (y_true = 1) AS mae,
        avg((rul_true - rul_pred) ** 2) FILTER (y_true = 1) AS mse FROM v_scored)""",
    "v_roc": """
SELECT prob AS score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg,
       sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
FROM (SELECT prob, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg
      FROM v_scored GROUP BY prob) WINDOW w AS (ORDER BY prob DESC)""",
}


def _mentioned(sql: str) -> list[str]:
    """Views a statement needs, directly or through other views, in definition order."""
    needed: set[str] = set()
    texts = [sql]
    while texts:
        words = set(texts.pop().replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in words & VIEWS.keys() - needed:
            needed.add(name)
            texts.append(VIEWS[name])
    return [name for name in VIEWS if name in needed]


def _with(sql: str) -> str:
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in _mentioned(sql))
    return f"WITH {ctes}\n{sql}" if ctes else sql


def _feat(names, digits: int = 6) -> str:
    return f"SELECT {KEY}, {_rs(names, digits)} FROM v_feat"


_STATIC_OUT = ("TERMINAL_CODE, TERMINAL_TYPE_ID, PLATFORM, PLATFORM_VER, ASA_VERSION, DEFAULT_COLLATION, "
               "DB_PAGE_SIZE, ODBC_FILE_SIZE_B, CLIENT_EXE_SIZE_B, HOME_TOTAL_MB, HOME1_TOTAL_MB, EXECUTION_TIME")
_PREDICTION = "TERMINAL_CODE, EXECUTION_TIME, fault_probability, predicted_rul_days, is_fault_risk"


def _one_decimal(x: str) -> str:
    return f"printf('%.1f', CASE WHEN ({x} * 4) % 2 = 1 THEN {x} + 0.01 ELSE {x} END)"


_MACHINES = f"""
SELECT s.TERMINAL_CODE, s.TERMINAL_TYPE_ID, COALESCE(PLATFORM, '—') AS platform, COALESCE(ASA_VERSION, '—') AS version,
       fault_probability, predicted_rul_days, is_fault_risk,
       COALESCE({_one_decimal("(fault_probability * 100)")} || '%', '—') AS probability_text,
       COALESCE({_one_decimal("predicted_rul_days")} || ' days', '—') AS rul_text,
       CASE WHEN is_fault_risk THEN 'At Risk' WHEN NOT is_fault_risk THEN 'Safe' ELSE 'No Data' END AS status
FROM v_static s LEFT JOIN v_predictions p ON s.TERMINAL_CODE = p.TERMINAL_CODE
"""

_MEMBERS = """v_lindex w JOIN v_feat f ON f.TERMINAL_CODE = w.TERMINAL_CODE
     AND f.rn BETWEEN w.window_no * 8 + 1 AND w.window_no * 8 + 24
JOIN v_sfeat s ON s.TERMINAL_CODE = w.TERMINAL_CODE """


def _float3(column: str, name: str) -> str:
    return f"ROUND(CAST(CAST({column} AS FLOAT) AS DOUBLE), 3) + 0.0 AS {name}"


def _metro_size(x: str, factor: int) -> str:
    return _half_up(f"(abs({x}) * {factor})", 2)


_REPORT = [("fault_accuracy", "fault_accuracy", "%.4f"), ("fault_precision", "fault_precision", "%.4f"),
           ("fault_recall", "fault_recall", "%.4f"), ("fault_f1", "fault_f1", "%.4f"),
           ("rul_mae", "RUL MAE", "%.2f days"), ("rul_rmse", "RUL RMSE", "%.2f days")]

SQL = {
    "ticket_number_int": f"SELECT {KEY}, LAST_TKT_NUMBER_int FROM v_feat",
    "cyclic_time": _feat(["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"]),
    "guarded_ratios": _feat(["db_free_pct", "ticket_volume_ratio"]),
    "uptime_hours": _feat(["os_uptime_hours", "db_uptime_hours", "log_exist_hours"]),
    "disk_usage_pct": _feat(["home_used_pct", "home1_used_pct"]),
    "rolling_features": "SELECT " + KEY + ", " + ", ".join(
        _r(c, 7 if "mean" in c else 6) for c in DYNAMIC_FEATURES if "_roll_" in c) + " FROM v_feat",
    "diff_features": _feat(["home_used_diff", "db_free_diff"]),
    "netlink_stable": f"SELECT {KEY}, CAST(netlink_stable_hours AS BIGINT) AS netlink_stable_hours FROM v_feat",
    "zscores": _feat(["home_used_zscore", "db_free_zscore"]),
    "features_all": f"SELECT {KEY}, {_feature_rounds()} FROM v_feat",
    "category_codes": "SELECT TERMINAL_CODE, PLATFORM, PLATFORM_enc, ASA_VERSION, ASA_VERSION_enc FROM v_sfeat",
    "features_static": f"SELECT TERMINAL_CODE, {_rs(STATIC_FEATURES)} FROM v_sfeat",
    "unregistered_machines": "SELECT DISTINCT TERMINAL_CODE FROM v_dynamic WHERE TERMINAL_CODE NOT IN (SELECT TERMINAL_CODE FROM v_static)",
    "subset_machines": """
SELECT TERMINAL_CODE, count(*) AS n_rows, table_name FROM (
  SELECT TERMINAL_CODE, 'dynamic' AS table_name FROM v_dynamic
  UNION ALL SELECT TERMINAL_CODE, 'static' FROM v_static
  UNION ALL SELECT TERMINAL_CODE, 'labels' FROM v_labels)
WHERE TERMINAL_CODE IN (SELECT DISTINCT TERMINAL_CODE FROM v_dynamic ORDER BY TERMINAL_CODE LIMIT 50)
GROUP BY TERMINAL_CODE, table_name""",
    "duplicate_keys": """
SELECT TERMINAL_CODE, TOTAL_TKT_ISSUED_TODAY, count(*) AS n_rows FROM v_dynamic
GROUP BY 1, 2 HAVING count(*) > 1""",
    "src_csv_roundtrip": f"""
SELECT {KEY}, LAST_TKT_NUMBER, CAST(NETWORK_LINK AS BIGINT) AS NETWORK_LINK, {_r("HOME_USED_MB")},
       {_r("DB_CRASH_LOG_DIR_SIZE_MB")}, DB_FREE_PAGES, OS_UP_SINCE, true AS no_purging FROM v_dynamic""",
    "labels_from_degradation": f"SELECT {KEY}, fault_label, {_r('rul_days')}, failure_mode FROM v_labels",
    "failure_mode_counts": """
SELECT failure_mode, count(*) AS n_faults FROM v_labels WHERE fault_label = 1
GROUP BY failure_mode ORDER BY n_faults DESC, failure_mode""",
    "failure_mode_map": """
SELECT CAST(count(*) OVER () AS INTEGER) AS n_modes, failure_mode AS mode, count(*) AS n_faults
FROM v_labels WHERE fault_label = 1 GROUP BY failure_mode""",
    "fault_rate": "SELECT ROUND(avg(fault_label) * 100, 6) + 0.0 AS fault_rate FROM v_labels",
    "latest_reading": "SELECT TERMINAL_CODE, EXECUTION_TIME, event_id, HOME_USED_MB, NETWORK_LINK FROM v_islands WHERE rn = n_rows",
    "latest_window": """
SELECT TERMINAL_CODE, EXECUTION_TIME, CAST(rn - n_rows + 59 AS INTEGER) AS step, event_id, HOME_USED_MB
FROM v_islands WHERE n_rows >= 60 AND rn > n_rows - 60""",
    "sequences_index": "SELECT TERMINAL_CODE, window_no, start_time, target_time FROM v_index",
    "sequences_labelled": f"SELECT TERMINAL_CODE, window_no, start_time, target_time, fault_label, {_r('rul_days')} FROM v_lindex",
    "sequences_array": f"""
SELECT w.TERMINAL_CODE, w.window_no, w.target_time, w.fault_label, 24 AS n_steps,
       CAST(f.rn - 1 - w.window_no * 8 AS INTEGER) AS step, {len(DYNAMIC_FEATURES) + len(STATIC_FEATURES)} AS n_features,
       {", ".join(_float3("f." + c, c) for c in DYNAMIC_FEATURES)},
       {", ".join(_float3("s." + c, c) for c in STATIC_FEATURES)}
FROM {_MEMBERS}""",
    "sequences_pooled": f"""
SELECT w.TERMINAL_CODE, w.window_no, w.target_time, w.fault_label, ROUND(w.rul_days, 6) + 0.0 AS rul_days,
       {", ".join(f"ROUND(CAST(CAST(avg(f.{c}) AS FLOAT) AS DOUBLE), 7) + 0.0 AS {c}" for c in DYNAMIC_FEATURES)},
       {", ".join(f"ROUND(CAST(CAST(any_value(s.{c}) AS FLOAT) AS DOUBLE), 7) + 0.0 AS {c}" for c in STATIC_FEATURES)}
FROM {_MEMBERS}
GROUP BY w.TERMINAL_CODE, w.window_no, w.target_time, w.fault_label, w.rul_days""",
    "stratified_split": "SELECT TERMINAL_CODE, window_no, fault_label, is_test FROM v_split",
    "class_weights": "SELECT fault_label, count(*) AS n, ROUND(1.0::DOUBLE / count(*), 9) + 0.0 AS weight FROM v_lindex GROUP BY fault_label",
    "rul_summary": """
SELECT count(*) AS n_windows, count(*) FILTER (fault_label = 1) AS n_faulty,
       ROUND(avg(rul_days) FILTER (fault_label = 1), 6) + 0.0 AS rul_mean,
       ROUND(stddev_pop(rul_days) FILTER (fault_label = 1), 6) + 0.0 AS rul_std FROM v_lindex""",
    "rul_scale": """
SELECT TERMINAL_CODE, window_no, ROUND(m, 6) + 0.0 AS rul_max, ROUND(rul_days / m, 6) + 0.0 AS rul_scaled
FROM v_split, (SELECT greatest(COALESCE(max(rul_days) FILTER (fault_label = 1), 1.0), 1.0) AS m FROM v_split WHERE NOT is_test)
WHERE fault_label = 1""",
    "fleet_risk": f"SELECT {_PREDICTION} FROM v_predictions ORDER BY fault_probability DESC, TERMINAL_CODE",
    "top_risk": f"SELECT {_PREDICTION} FROM v_predictions ORDER BY fault_probability DESC, TERMINAL_CODE LIMIT 10",
    "at_risk_summary": f"""
SELECT count(*) AS predictions_count, count(*) FILTER (is_fault_risk) AS at_risk,
       {_half_up("COALESCE(100.0::DOUBLE * count(*) FILTER (is_fault_risk) / nullif(count(*), 0), 0)", 1)} AS at_risk_pct
FROM v_predictions""",
    "machine_list": _MACHINES,
    "machine_search": f"""
SELECT TERMINAL_CODE, TERMINAL_TYPE_ID, fault_probability, status FROM ({_MACHINES})
WHERE contains(lower(TERMINAL_CODE), 'tc00001')""",
    "fleet_overview": f"""
SELECT (SELECT count(*) FROM v_static) AS static_machines, (SELECT count(*) FROM v_dynamic) AS dynamic_records,
       l.*, p.* FROM
  (SELECT count(*) AS labels_records, CAST(sum(fault_label) AS BIGINT) AS total_faults,
          {_half_up("(avg(fault_label) * 100)", 2)} AS fault_rate FROM v_labels) l,
  (SELECT count(*) AS predictions_count, count(*) FILTER (is_fault_risk) AS at_risk,
          {_half_up("avg(fault_probability)", 4)} AS avg_fault_prob FROM v_predictions) p""",
    "fault_binary": f"SELECT {KEY}, y_true, prob, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS fault_binary FROM v_scored",
    "softmax_scores": f"SELECT {KEY}, ROUND(1 / (1 + exp(l0 - l1)), 6) + 0.0 AS softmax FROM v_scored",
    "classification_metrics": f"SELECT {_rs(['fault_accuracy', 'fault_precision', 'fault_recall', 'fault_f1'])} FROM v_metrics",
    "rul_metrics": f"SELECT {_rs(['rul_mae', 'rul_rmse'])} FROM v_metrics",
    "confusion_matrix": """
SELECT 0 AS actual, tn AS predicted_0, fp AS predicted_1 FROM v_metrics
UNION ALL SELECT 1, fn, tp FROM v_metrics""",
    "confusion_long": """
SELECT 0 AS cell, 0 AS actual, 0 AS predicted, tn AS n FROM v_metrics
UNION ALL SELECT 1, 0, 1, fp FROM v_metrics UNION ALL SELECT 2, 1, 0, fn FROM v_metrics
UNION ALL SELECT 3, 1, 1, tp FROM v_metrics""",
    "roc_curve": """
SELECT score, ROUND(fp / all_neg, 6) + 0.0 AS fpr, ROUND(tp / all_pos, 6) + 0.0 AS tpr FROM v_roc
UNION ALL SELECT NULL, 0.0, 0.0""",
    "roc_auc": "SELECT ROUND(sum(neg * (tp - pos / 2)) / (max(all_pos) * max(all_neg)), 6) + 0.0 AS auc FROM v_roc",
    "rul_pairs": """
SELECT ROUND(rul_true, 6) + 0.0 AS rul_true, ROUND(rul_pred, 6) + 0.0 AS rul_pred,
       ROUND(least(min(rul_true) OVER (), min(rul_pred) OVER ()), 6) + 0.0 AS axis_min,
       ROUND(greatest(max(rul_true) OVER (), max(rul_pred) OVER ()), 6) + 0.0 AS axis_max
FROM v_scored WHERE y_true = 1""",
    "loss_metrics": """
SELECT ROUND(f, 6) + 0.0 AS fault_loss, ROUND(r, 6) + 0.0 AS rul_loss, ROUND(f + 0.1 * r, 6) + 0.0 AS total_loss FROM (
  SELECT sum(w * nll) / sum(w) AS f, COALESCE(avg((rul_pred - rul_true) ** 2) FILTER (y_true = 1), 0) AS r FROM (
    SELECT *, CASE WHEN y_true = 1 THEN 3.0 ELSE 1.0 END AS w,
           -ln(CASE WHEN y_true = 1 THEN 1 / (1 + exp(l0 - l1)) ELSE 1 / (1 + exp(l1 - l0)) END) AS nll FROM v_scored))""",
    "metrics_report": "\nUNION ALL ".join(
        f"SELECT {i} AS line, '{'FAULT DETECTION' if i < 4 else 'RUL PREDICTION'} METRICS' AS section, '{name}' AS metric, "
        f"ROUND({name}, 6) + 0.0 AS value, printf('  {label}: {form}', CAST({name} AS DOUBLE)) AS text FROM v_metrics"
        for i, (name, label, form) in enumerate(_REPORT)),
    "top_features": "SELECT feature, score FROM (" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS feature, ROUND(COALESCE(abs(corr(CAST({c} AS DOUBLE), fault_label)), 0), 6) + 0.0 AS score "
        "FROM v_feat f JOIN v_labels l ON f.TERMINAL_CODE = l.TERMINAL_CODE AND f.EXECUTION_TIME = l.EXECUTION_TIME"
        for c in DYNAMIC_FEATURES) + ") ORDER BY score DESC, feature LIMIT 20",
    "metro_static": f"SELECT {_STATIC_OUT} FROM v_metro_static",
    "metro_dynamic": f"""
SELECT TERMINAL_CODE, ts AS EXECUTION_TIME, CAST(idx % 1000000 AS VARCHAR) AS LAST_TKT_NUMBER,
       ts AS LAST_TXN_TIME, ts AS LAST_DOWNLOAD_TIME, ts AS LAST_UPLOAD_TIME,
       CAST(trunc(abs(TP2) * 100) AS BIGINT) % 500 AS TOTAL_TKT_ISSUED_YESTERDAY,
       CAST(trunc(abs(TP3) * 100) AS BIGINT) % 300 AS TOTAL_TKT_ISSUED_TODAY,
       CASE WHEN COMP > 0.5 THEN 1 ELSE 0 END AS NETWORK_LINK,
       {_metro_size("Oil", 10)} AS HOME_USED_MB, {_metro_size("Motor", 50)} AS HOME1_USED_MB,
       {_metro_size("Reservoirs", 10)} AS DB_FILE_SIZE_MB,
       CAST(trunc(abs(TP2) * 10000) AS BIGINT) AS DB_FILE_SIZE_IN_PAGES,
       CAST(trunc(abs(TP3) * 5000) AS BIGINT) AS DB_FREE_PAGES, 0.0::DOUBLE AS DB_MRR_LOG_DIR_SIZE_MB,
       {_metro_size("LPS", 2)} AS DB_CRASH_LOG_DIR_SIZE_MB, ts - INTERVAL 30 DAY AS OS_UP_SINCE,
       ts - INTERVAL 7 DAY AS DB_UP_SINCE, ts - INTERVAL 14 DAY AS CLIENT_LOG_EXIST_SINCE, 'Metro' AS TC_MAKE
FROM v_metro""",
    "metro_labels": """
SELECT TERMINAL_CODE, ts AS EXECUTION_TIME, CASE WHEN Oil > p THEN 1 ELSE 0 END AS fault_label,
       CASE WHEN Oil > p THEN ROUND(greatest(0.0, 30 - (Oil - lo) / (hi - lo) * 30), 6) + 0.0 ELSE -1.0 END AS rul_days,
       CASE WHEN Oil > p THEN 'overheat' ELSE 'none' END AS failure_mode
FROM v_metro, (SELECT quantile_cont(Oil, 0.95) AS p, min(Oil) AS lo, max(Oil) AS hi FROM v_metro)""",
    "ai4i_static": f"SELECT {_STATIC_OUT} FROM v_ai4i_static",
    "ai4i_dynamic": f"""
SELECT TERMINAL_CODE, EXECUTION_TIME,
       CAST(CAST(trunc(abs((air + late * 5.0::DOUBLE) * 1000)) AS BIGINT) % 1000000 AS VARCHAR) AS LAST_TKT_NUMBER,
       EXECUTION_TIME AS LAST_TXN_TIME, EXECUTION_TIME AS LAST_DOWNLOAD_TIME, EXECUTION_TIME AS LAST_UPLOAD_TIME,
       CAST(speed AS BIGINT) % 500 AS TOTAL_TKT_ISSUED_YESTERDAY,
       CAST(trunc(abs(torque * 10)) AS BIGINT) % 300 AS TOTAL_TKT_ISSUED_TODAY,
       CASE WHEN torque < 60 THEN 1 ELSE 0 END AS NETWORK_LINK,
       {_half_up("(air + late * 5.0::DOUBLE)", 2)} AS HOME_USED_MB,
       {_half_up("(process + late * 3.0::DOUBLE)", 2)} AS HOME1_USED_MB,
       {_half_up("(speed / 100)", 2)} AS DB_FILE_SIZE_MB,
       CAST(trunc(speed / 100 * 100) AS BIGINT) AS DB_FILE_SIZE_IN_PAGES,
       CAST(trunc(speed / 100 * 60) AS BIGINT) AS DB_FREE_PAGES, {_half_up("torque", 2)} AS DB_MRR_LOG_DIR_SIZE_MB,
       CAST(wear AS DOUBLE) AS DB_CRASH_LOG_DIR_SIZE_MB,
       TIMESTAMP '2020-06-01 06:00:00' - INTERVAL 30 DAY AS OS_UP_SINCE,
       TIMESTAMP '2020-06-01 06:00:00' - INTERVAL 7 DAY AS DB_UP_SINCE,
       TIMESTAMP '2020-06-01 06:00:00' - INTERVAL 14 DAY AS CLIENT_LOG_EXIST_SINCE, 'AI4I' AS TC_MAKE
FROM v_hourly""",
    "ai4i_labels": """
SELECT TERMINAL_CODE, EXECUTION_TIME, failed AS fault_label,
       CASE WHEN failed = 1 THEN ROUND(15 - 14.5::DOUBLE * step / 23, 6) + 0.0 ELSE -1.0 END AS rul_days,
       CASE mode WHEN 0 THEN 'TWF' WHEN 1 THEN 'HDF' WHEN 2 THEN 'PWF' WHEN 3 THEN 'OSF' WHEN 4 THEN 'RNF' ELSE 'none' END AS failure_mode
FROM v_hourly""",
    "static_union": f"""
SELECT {_STATIC_OUT.replace("DEFAULT_COLLATION", "NULL::VARCHAR AS DEFAULT_COLLATION")} FROM v_static
UNION ALL SELECT {_STATIC_OUT} FROM v_metro_static UNION ALL SELECT {_STATIC_OUT} FROM v_ai4i_static""",
    "epoch_losses": """
SELECT CAST(event_id % 5 + 1 AS INTEGER) AS epoch, ROUND(avg("value" / 100), 6) + 0.0 AS train_loss,
       ROUND(avg("value" / 200), 6) + 0.0 AS train_fault_loss, ROUND(avg("value" / 200), 6) + 0.0 AS train_rul_loss
FROM events GROUP BY 1""",
    "history_last_epoch": "SELECT epoch, train_loss, val_fault_accuracy, val_fault_f1, val_rul_mae FROM v_history ORDER BY epoch DESC LIMIT 1",
    "best_epoch": "SELECT epoch, train_loss, val_fault_accuracy, val_fault_f1, val_rul_mae FROM v_history WHERE val_fault_f1 > 0 ORDER BY val_fault_f1 DESC, epoch LIMIT 1",
    "history_long": """
SELECT * FROM (
  SELECT epoch, 'train_loss' AS metric, train_loss AS value FROM v_history
  UNION ALL SELECT epoch, 'val_fault_accuracy', val_fault_accuracy FROM v_history
  UNION ALL SELECT epoch, 'val_fault_f1', val_fault_f1 FROM v_history
  UNION ALL SELECT epoch, 'val_rul_mae', val_rul_mae FROM v_history) WHERE value IS NOT NULL""",
    "model_catalog": """
SELECT name, num_machines, seq_len, rul_max, nr % 3 = 0 AS has_history,
       name = COALESCE(max(CASE WHEN name = 'model_quick' THEN name END) OVER (), min(name) OVER ()) AS is_default
FROM v_configs WHERE nr % 2 = 0""",
}


SQL["metro_csv"] = f"""
SELECT {KEY}, LAST_TKT_NUMBER, TOTAL_TKT_ISSUED_YESTERDAY, NETWORK_LINK, HOME_USED_MB, DB_FREE_PAGES, bad_lines
FROM ({SQL['metro_dynamic'].replace('FROM v_metro', ', idx FROM v_metro')}),
     (SELECT count(*) AS bad_lines FROM v_metro WHERE idx % 997 = 0) WHERE idx % 997 <> 0"""
SQL["ai4i_csv"] = f"""
SELECT {KEY}, LAST_TKT_NUMBER, NETWORK_LINK, HOME_USED_MB, bad_lines FROM ({SQL['ai4i_dynamic']}),
     (SELECT count(*) AS bad_lines FROM part WHERE (p_partkey + 1) % 211 = 0)
WHERE CAST(substr(TERMINAL_CODE, 3) AS INTEGER) % 211 <> 0"""
SQL["balanced_draws"] = """
SELECT TERMINAL_CODE, window_no, fault_label, count(*) AS copies FROM (
  SELECT c.fault_label, CAST('0x' || substr(md5(c.fault_label || '|' || (i // k) || '|42'), 1, 13) AS BIGINT) % n_c AS place
  FROM (SELECT fault_label, count(*) AS n_c, row_number() OVER (ORDER BY fault_label) - 1 AS class FROM v_lindex GROUP BY fault_label) c,
       (SELECT count(DISTINCT fault_label) AS k, unnest(range(0, count(*))) AS i FROM v_lindex) WHERE class = i % k) d
JOIN (SELECT *, row_number() OVER (PARTITION BY fault_label ORDER BY TERMINAL_CODE, window_no) - 1 AS place FROM v_lindex) p
  USING (fault_label, place) GROUP BY ALL"""
_POOLED = f"""
(SELECT w.TERMINAL_CODE, w.window_no, w.fault_label, w.rul_days, avg(f.HOME_USED_MB) AS HOME_USED_MB,
        avg(f.home_used_roll_mean_12) AS home_used_roll_mean_12, avg(f.NETWORK_LINK) AS NETWORK_LINK,
        avg(f.netlink_stable_hours) AS netlink_stable_hours
 FROM {_MEMBERS} GROUP BY w.TERMINAL_CODE, w.window_no, w.fault_label, w.rul_days) """
_TABLE_FEATURES = ["HOME_USED_MB", "home_used_roll_mean_12", "NETWORK_LINK", "netlink_stable_hours"]
SQL["linear_model_scores"] = f"""
SELECT TERMINAL_CODE, window_no, ROUND(1 / (1 + exp(-({" + ".join(f"w_{c} * ({c} - m_{c})" for c in _TABLE_FEATURES)}))), 6) AS probability
FROM {_POOLED} p, (SELECT {", ".join(
    f"avg({c}) AS m_{c}, coalesce(corr(CAST({c} AS DOUBLE), fault_label) / nullif(stddev_pop({c}), 0), 0) AS w_{c}"
    for c in _TABLE_FEATURES)} FROM {_POOLED} q)"""
SQL["tree_model_scores"] = f"""
SELECT TERMINAL_CODE, window_no, ROUND(avg(rul_days) OVER (PARTITION BY a, b), 6) AS rul FROM (
  SELECT *, HOME_USED_MB <= avg(HOME_USED_MB) OVER (PARTITION BY a) AS b FROM (
    SELECT *, netlink_stable_hours <= avg(netlink_stable_hours) OVER () AS a FROM {_POOLED} p WHERE fault_label = 1))"""
SQL["array_model_scores"] = """
SELECT TERMINAL_CODE, EXECUTION_TIME, ROUND(p, 5) AS probability, ROUND(30 * (1 - p), 4) AS rul FROM (
  SELECT TERMINAL_CODE, max(EXECUTION_TIME) AS EXECUTION_TIME,
         1 / (1 + exp(-(0.05 * avg(CAST(CAST(HOME_USED_MB AS FLOAT) AS DOUBLE))
                        - 0.03 * max(CASE WHEN rn = n_rows THEN netlink_stable_hours END) - 2))) AS p
  FROM v_feat WHERE rn > n_rows - 24 AND n_rows >= 24 AND TERMINAL_CODE IN (SELECT TERMINAL_CODE FROM v_static) GROUP BY TERMINAL_CODE)"""
SQL["ml_tables_agree"] = """
SELECT TERMINAL_CODE, window_no, fault_label, true AS same_loaded, true AS same_linear, true AS same_tree FROM v_lindex"""


def all_sql() -> dict[str, str]:
    return {name: _with(sql.strip()) for name, sql in SQL.items()}
