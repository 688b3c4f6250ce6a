"""SQL building blocks of the check engine."""

from __future__ import annotations

from verification.binding import duck_events_sql
from wardlight import fixed_values as fv

FEATURES = ["hour", "day_of_week", "is_weekend", "is_off_hours",
            *[f"et_{t}" for t in fv.INDICATOR_EVENT_TYPES],
            "has_domain", "domain_len", "is_exfil_domain", "bytes_sent_log", "bytes_received_log",
            "has_file", "file_size_log", "is_removable_media", "device_managed", "has_admin_rights",
            "security_training_current", "weak_auth", "risky_network_zone", "is_shadow_it",
            "sanction_unsanctioned", "external_recipient", "is_departing_employee"]


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def case_map(expr: str, mapping: dict, default: str | None = None) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    tail = f" ELSE '{default}'" if default is not None else ""
    return f"CASE {expr} {whens}{tail} END"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


EV = f"ev AS ({duck_events_sql()})"

_exfil = " OR ".join(f"contains(lower(coalesce(domain, '')), '{h}')" for h in fv.EXFIL_DOMAIN_HINTS)
_onehot = ",\n  ".join(f"CAST(event_type = '{t}' AS INT) AS et_{t}" for t in fv.INDICATOR_EVENT_TYPES)

FM = f"""fm AS (
SELECT event_id, ts, d, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week,
  CAST(isodow(ts) >= 6 AS INT) AS is_weekend,
  CAST(hour(ts) < 7 OR hour(ts) >= 19 AS INT) AS is_off_hours,
  {_onehot},
  CAST(domain IS NOT NULL AS INT) AS has_domain, CAST(length(coalesce(domain, '')) AS INT) AS domain_len,
  CAST({_exfil} AS INT) AS is_exfil_domain,
  CASE WHEN bytes_sent <> 0 THEN ln(1 + bytes_sent) ELSE 0 END AS bytes_sent_log,
  CASE WHEN bytes_received <> 0 THEN ln(1 + bytes_received) ELSE 0 END AS bytes_received_log,
  CAST(file_name IS NOT NULL AS INT) AS has_file,
  CASE WHEN file_size_kb <> 0 THEN ln(1 + file_size_kb) ELSE 0 END AS file_size_log,
  CAST(to_removable_media OR from_removable_media
       OR coalesce(shadow_it_category = '{fv.REMOVABLE_CATEGORY}', false) AS INT) AS is_removable_media,
  CAST(coalesce(device_managed, -1) AS INT) AS device_managed,
  CAST(coalesce(has_admin_rights, -1) AS INT) AS has_admin_rights,
  CAST(coalesce(security_training_current, -1) AS INT) AS security_training_current,
  CAST(coalesce(auth_method IN ({quoted(fv.WEAK_AUTH_METHODS)}), false) AS INT) AS weak_auth,
  CAST(coalesce(network_zone IN ({quoted(fv.RISKY_NETWORK_ZONES)}), false) AS INT) AS risky_network_zone,
  coalesce(is_shadow_it, 0) AS is_shadow_it,
  CAST(coalesce(sanction_status = 'Unsanctioned', false) AS INT) AS sanction_unsanctioned,
  CAST(coalesce(external_recipient, false) AS INT) AS external_recipient,
  CAST(coalesce(is_departing_employee, -1) AS INT) AS is_departing_employee,
  label AS _label, source AS _source, username AS _username, shadow_it_category,
  scenario_id, threat_scenario
FROM ev)"""

_ub = ",\n  ".join(
    f"avg({f}) FILTER (WHERE _label = 0) AS u_{f}"
    + (f", coalesce(stddev_samp({f}) FILTER (WHERE _label = 0), 0) AS us_{f}"
       if not f.startswith("et_") else "")
    for f in FEATURES)
UB = f"""ub AS (
SELECT _username AS username, min_by(_source, ts) AS source,
  CAST(sum(_label) AS BIGINT) AS labeled_anomaly_count,
  count(*) FILTER (WHERE _label = 0) AS event_count, {_ub}
FROM fm GROUP BY _username)"""

_ss = ",\n  ".join(
    f"avg({f}) FILTER (WHERE _label = 0) AS p_{f}, stddev_samp({f}) FILTER (WHERE _label = 0) AS ps_{f}"
    for f in FEATURES)
SS = f"""ss AS (
SELECT _source AS source, count(*) AS n_total_events, count(*) FILTER (WHERE _label = 0) AS n_normal_events,
  count(DISTINCT _username) FILTER (WHERE _label = 0) AS n_users, avg(_label) AS anomaly_rate, {_ss}
FROM fm GROUP BY _source)"""


def _blend(u: str, p: str) -> str:
    w = "(event_count / (event_count + 30.0))"
    return f"({w} * coalesce({u}, {p}) + (1 - {w}) * {p})"


def _dev(f: str) -> str:
    mean = _blend(f"u_{f}", f"p_{f}")
    gap = f"abs({f} - {mean})"
    if f in fv.CONTINUOUS_FEATURES:
        std = _blend(f"us_{f}", f"ps_{f}")
        body = (f"CASE WHEN {std} IS NULL THEN NULL WHEN {std} < 1e-9 THEN "
                f"CASE WHEN {gap} < 1e-9 THEN 0.0 ELSE 1.0 END ELSE least({gap} / {std}, 8.0) / 8.0 END")
    else:
        body = f"least({gap}, 1.0)"
    return f"CASE WHEN {f} = -1 OR p_{f} = -1 THEN NULL ELSE {body} END"


DEV = ("dev AS (SELECT fm.*, "
       + ",\n ".join(f"{_dev(f)} AS d_{f}" for f in FEATURES)
       + " FROM fm JOIN ub ON fm._username = ub.username JOIN ss ON fm._source = ss.source)")
_sum = " + ".join(f"coalesce(d_{f}, 0)" for f in FEATURES)
_n = " + ".join(f"CAST(d_{f} IS NOT NULL AS INT)" for f in FEATURES)
SC = f"""sc AS (
SELECT event_id, ts, d, _username, _source, _label, shadow_it_category, scenario_id, threat_scenario,
  CASE WHEN is_removable_media = 1 THEN 'is_removable_media' WHEN external_recipient = 1 THEN 'external_recipient'
    WHEN is_exfil_domain = 1 THEN 'is_exfil_domain' END AS cert_signal,
  ({_sum}) / nullif({_n}, 0) AS anomaly_score
FROM dev)"""
DAY = """dy AS (
SELECT _username, _source, d AS date, max(anomaly_score) AS daily_max_score, avg(anomaly_score) AS daily_mean_score,
  count(*) AS daily_event_count, CAST(sum(_label) AS BIGINT) AS daily_labeled_anomaly_count,
  min_by(event_id, row(-anomaly_score, event_id)) AS driver_event_id,
  min_by(shadow_it_category, row(-anomaly_score, event_id)) AS x_category,
  min_by(cert_signal, row(-anomaly_score, event_id)) AS x_signal
FROM sc GROUP BY _username, _source, d),
dr AS (SELECT dy.*, sc.shadow_it_category, sc.cert_signal
FROM dy JOIN sc ON dy.driver_event_id = sc.event_id),
rk AS (SELECT *, 0.7 * daily_max_score + 0.3 * daily_mean_score AS raw_composite_score FROM dr),
rs0 AS (SELECT *, rank() OVER (ORDER BY raw_composite_score) AS r,
  count(*) OVER (PARTITION BY raw_composite_score) AS c, count(*) OVER () AS n FROM rk),
rs AS (SELECT *, (r + (c - 1) / 2.0) / n * 100 AS pct,
  CASE WHEN (r + (c - 1) / 2.0) / n * 100 >= 99 THEN 'Critical' WHEN (r + (c - 1) / 2.0) / n * 100 >= 97 THEN 'High'
    WHEN (r + (c - 1) / 2.0) / n * 100 >= 90 THEN 'Medium' WHEN (r + (c - 1) / 2.0) / n * 100 >= 70 THEN 'Low'
    ELSE 'Informational' END AS risk_category FROM rs0)"""

MATRIX = ctes(EV, FM)
BASE = ctes(EV, FM, UB, SS)
SCORES = ctes(EV, FM, UB, SS, DEV, SC)
RISK = ctes(EV, FM, UB, SS, DEV, SC, DAY)


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)
