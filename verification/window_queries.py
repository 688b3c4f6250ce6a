"""Trailing-window baselines, live features and nightly jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from verification import sql as S
from verification.behaviour_queries import (
    _DIST, APP, CAT, HIST, RB, SE, _SPREADS, _Z, _signals, app_catalogue, baselines, signal_text)
from verification.binding import canonical_events, flat_events, security_events
from verification.core_queries import r6
from verification.registry import query
from verification.scalar_queries import _KEY, CE
from wardlight import fixed_values as fv
from wardlight.operators import catalogue, point_in_time as P, robust
from wardlight.plans import nightly

# Brute force: every event beside every earlier event of its user in the seven days before.
PIT = f"""pj AS (SELECT e.event_id AS eid2, e.mi AS emi, h.* FROM se e JOIN se h ON e.user_id = h.user_id
  AND h.occurred_at < e.occurred_at AND h.occurred_at >= e.occurred_at - INTERVAL 7 DAY),
pd AS (SELECT eid2, d, sum(bytes_transferred) AS b FROM pj GROUP BY ALL),
qpm AS (SELECT eid2, median(b) AS m, count(*) AS sample_days FROM pd GROUP BY eid2),
ps AS (SELECT eid2, any_value(m) AS daily_volume_median, any_value(sample_days) AS sample_days, CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(1.4826 * median(abs(b - m)), 1.0) END AS daily_volume_scale
  FROM pd JOIN qpm USING (eid2) GROUP BY eid2),
lj AS (SELECT pj.* FROM pj JOIN se e ON pj.eid2 = e.event_id AND e.event_type = 'login' WHERE pj.event_type = 'login'),
qlc AS (SELECT eid2, mi, min(occurred_at) AS ft FROM lj GROUP BY ALL),
qco AS (SELECT qlc.eid2, qlc.mi, qlc.ft, sum({_DIST.format(a='lj.mi', b='qlc.mi')}) AS cost FROM qlc JOIN lj USING (eid2) GROUP BY ALL),
cc AS (SELECT eid2, min_by(mi, row(cost, ft)) AS c FROM qco GROUP BY eid2),
qld AS (SELECT eid2, c, {_DIST.format(a='mi', b='c')} AS dist FROM lj JOIN cc USING (eid2)),
qlm AS (SELECT eid2, median(dist) AS m, count(*) AS login_samples FROM qld GROUP BY eid2),
qlp AS (SELECT eid2, c / 60.0 AS login_hour_centre, any_value(login_samples) AS login_samples, CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(1.4826 * median(abs(dist - m)) / 60.0, 1.0) END AS login_hour_scale
  FROM qld JOIN qlm USING (eid2) GROUP BY eid2, c),
kn AS (SELECT DISTINCT pj.eid2 FROM pj JOIN se e ON pj.eid2 = e.event_id AND pj.domain = e.domain)"""
TRAILING = S.ctes(S.EV, SE, PIT)


@query("w3_trailing_baselines", TRAILING + "SELECT se.event_id, coalesce(sample_days, 0) AS sample_days, round(coalesce(daily_volume_median, 0), 6) AS daily_volume_median, "
       "round(coalesce(daily_volume_scale, 1), 6) AS daily_volume_scale, CASE WHEN se.event_type = 'login' THEN coalesce(login_samples, 0) END AS login_samples, "
       "round(login_hour_centre, 6) AS login_hour_centre, round(login_hour_scale, 6) AS login_hour_scale, kn.eid2 IS NOT NULL AS domain_known "
       "FROM se LEFT JOIN ps ON se.event_id = ps.eid2 LEFT JOIN qlp ON se.event_id = qlp.eid2 LEFT JOIN kn ON se.event_id = kn.eid2")
def w3(spark, sf):
    return P.trailing_baselines(security_events(spark, sf), _KEY).select(
        "event_id", "sample_days", *r6("daily_volume_median", "daily_volume_scale"), "login_samples",
        *r6("login_hour_centre", "login_hour_scale"), F.coalesce("domain_known", F.lit(False)).alias("domain_known"))


@query("w7_first_domain", TRAILING + "SELECT se.event_id, domain FROM se LEFT JOIN kn ON se.event_id = kn.eid2 WHERE domain IS NOT NULL AND kn.eid2 IS NULL")
def w7(spark, sf):
    return P.first_uses(security_events(spark, sf), "domain").select("event_id", "domain")


_PA = ("pa AS (SELECT e.event_id, cat.name, cat.category, cat.approval_state, cat.risk_weight FROM se e LEFT JOIN da ON e.domain = da.domain LEFT JOIN cat ON da.ord = cat.ord), "
       "ka AS (SELECT DISTINCT pj.eid2 FROM pj JOIN pa h ON pj.event_id = h.event_id JOIN pa e ON pj.eid2 = e.event_id AND h.name = e.name)")


@query("w7_first_ai_tool", S.ctes(S.EV, SE, PIT, CAT, APP, _PA) + "SELECT pa.event_id, name AS app FROM pa LEFT JOIN ka ON pa.event_id = ka.eid2 WHERE category = 'ai' AND ka.eid2 IS NULL")
def w7a(spark, sf):
    e = catalogue.with_app(security_events(spark, sf), app_catalogue(spark)).withColumn("app_name", F.col("app.name"))
    return P.first_uses(e, "app_name").where(F.col("app.category") == "ai").select("event_id", F.col("app_name").alias("app"))


_J14 = f"""ev2 AS (SELECT se.*, pa.name, pa.category, pa.approval_state, pa.risk_weight, ka.eid2 IS NOT NULL AS used, kn.eid2 IS NOT NULL AS known, sample_days, login_samples,
  {_DIST.format(a='se.mi', b='(login_hour_centre * 60)')} / 60.0 / login_hour_scale AS zt, abs(bytes_transferred - ps.daily_volume_median) / ps.daily_volume_scale AS zv
  FROM se JOIN pa USING (event_id) LEFT JOIN ka ON se.event_id = ka.eid2 LEFT JOIN kn ON se.event_id = kn.eid2 LEFT JOIN ps ON se.event_id = ps.eid2 LEFT JOIN qlp ON se.event_id = qlp.eid2),
ev3 AS (SELECT ev2.*, abs(bytes_transferred - pb.daily_volume_median) / pb.daily_volume_scale AS zp, cohort_size FROM ev2 LEFT JOIN pb USING (department))"""


@query("j14_point_in_time_signals", S.ctes(S.EV, SE, HIST, RB, PIT, CAT, APP, _PA, _J14) + "SELECT event_id, " + _signals(
    ("unknown_application", "CASE WHEN domain IS NOT NULL AND name IS NULL THEN 0 END"),
    ("unapproved_app", "CASE WHEN approval_state = 'unapproved' THEN risk_weight END"),
    ("ai_tool_first_use", "CASE WHEN category = 'ai' AND NOT used THEN 15 END"),
    ("new_domain", "CASE WHEN domain IS NOT NULL AND NOT known AND sample_days >= 1 THEN 20 END"),
    ("time_anomaly", f"CASE WHEN login_samples >= 5 AND event_type = 'login' AND round(zt, 9) >= 3 THEN {_Z.format(z='round(zt, 9)')} END"),
    ("volume_anomaly", f"CASE WHEN sample_days >= 5 AND bytes_transferred > 0 AND zv >= 3 THEN {_Z.format(z='zv')} END"),
    ("peer_comparison", f"CASE WHEN cohort_size >= 5 AND bytes_transferred > 0 AND zp >= 3 THEN {_Z.format(z='zp')} END")) + " AS signals FROM ev3")
def j14(spark, sf):
    e = catalogue.with_app(security_events(spark, sf), app_catalogue(spark))
    peers = baselines(spark, sf)[1]
    return P.evaluate(e, peers, _KEY).select("event_id", signal_text().alias("signals"))


_RUN = "2024-01-22 12:00:00"
_TAIL = f"WHERE occurred_at >= TIMESTAMP '{_RUN}' - INTERVAL 7 DAY AND occurred_at <= TIMESTAMP '{_RUN}'"
_HS = ("se2 AS (SELECT event_id, username AS user_id, department, ts AS occurred_at, d, CASE WHEN event_type = 'login_event' THEN 'login' WHEN kind IN ('file_upload', 'dlp_outcome') "
       "THEN 'transfer' ELSE 'activity' END AS event_type, CASE WHEN event_type = 'cloud_upload' THEN bytes_sent ELSE 0 END AS bytes_transferred, domain, hour(ts) * 60 + minute(ts) AS mi FROM ce), "
       f"hs AS (SELECT * FROM se2 {_TAIL})")


def _robust_of(hs):
    return S.ctes(S.EV, CE, hs, RB)


@query("r4_baseline_refresh", _robust_of(_HS) + f"SELECT user_id, department, sample_days, login_samples, {S.r6(*_SPREADS)} FROM ub2")
def r4(spark, sf):
    users, _, _ = nightly.refresh_baselines(canonical_events(spark, sf), _RUN, _KEY)
    return users.select("user_id", "department", "sample_days", "login_samples", *r6(*_SPREADS))


@query("a23_refresh_counts", _robust_of(_HS) + "SELECT (SELECT count(*) FROM hs) AS events_considered, (SELECT count(*) FROM hs) AS events_adapted, "
       "(SELECT count(*) FROM ub2) AS users_recomputed, (SELECT count(*) FROM pb) AS departments_recomputed")
def a23(spark, sf):
    return nightly.refresh_counts(canonical_events(spark, sf), _RUN)


_LIVE = f"""lv AS (SELECT username, d, ts, k, CASE WHEN event_type = 'login_event' THEN 'et_login_event' WHEN kind = 'network_access' THEN 'et_browser_activity'
  WHEN kind = 'installed_application' THEN 'et_app_install' WHEN kind IN ('file_upload', 'dlp_outcome') THEN 'et_file_transfer' END AS ind,
  CAST({' OR '.join(f"contains(coalesce(domain, ''), '{h}')" for h in fv.LIVE_EXFIL_HINTS)} AS INT) AS exfil, CAST(to_removable_media AS INT) AS removable,
  CAST(hour(ts) < 7 OR hour(ts) >= 19 AS INT) AS off, CAST(isodow(ts) >= 6 AS INT) AS we, length(coalesce(domain, '')) AS dl,
  CASE WHEN event_type = 'cloud_upload' THEN bytes_sent ELSE 0 END AS b FROM ce WHERE ts >= TIMESTAMP '{_RUN}' - INTERVAL 7 DAY AND ts <= TIMESTAMP '{_RUN}')"""


@query("a4_live_user_days", S.ctes(S.EV, CE, _LIVE) + "SELECT username AS _username, CAST(d AS VARCHAR) AS date, count(*) AS daily_event_count, "
       + ", ".join(f"count(*) FILTER (WHERE ind = '{i}') AS {i}, round(count(*) FILTER (WHERE ind = '{i}') / count(*), 6) AS {i}_share"
                   for i in ("et_login_event", "et_browser_activity", "et_app_install", "et_file_transfer"))
       + ", CAST(sum(exfil) AS BIGINT) AS is_exfil_domain, CAST(sum(removable) AS BIGINT) AS is_removable_media, round(avg(off), 6) AS is_off_hours, round(avg(we), 6) AS is_weekend, "
       "max(dl) AS domain_len, round(max(ln(1 + b)), 6) AS bytes_sent_log, -1 AS device_managed FROM lv GROUP BY ALL")
def a4(spark, sf):
    d = nightly.live_user_days(canonical_events(spark, sf), _RUN)
    kinds = ("et_login_event", "et_browser_activity", "et_app_install", "et_file_transfer")
    return d.select("_username", F.col("date").cast("string").alias("date"), "daily_event_count", *kinds, *r6(*[f"{k}_share" for k in kinds]),
                    "is_exfil_domain", "is_removable_media", *r6("is_off_hours", "is_weekend"), "domain_len", *r6("bytes_sent_log"),
                    F.col("device_managed").cast("int").alias("device_managed"))


@query("a8_known_apps", S.ctes(S.EV, SE, CAT, APP) + "SELECT DISTINCT user_id, cat.name AS app_name FROM se JOIN da ON se.domain = da.domain JOIN cat ON da.ord = cat.ord")
def a8a(spark, sf):
    e = security_events(spark, sf)
    return robust.known_apps(e, catalogue.apps_of_domains(e, app_catalogue(spark)))


@query("m14_user_day_results", S.ctes(S.EV, CE) + ", g AS (SELECT username, d, max_by(event_id, row(rule_level, ts)) AS event_id, count(*) AS n, (max(k) + 1) / 100.0 AS p FROM ce GROUP BY ALL) "
       "SELECT event_id, username AS _username, CAST(d AS VARCHAR) AS date, CASE WHEN p >= 0.9984 THEN 'Critical' WHEN p >= 0.9926 THEN 'High' WHEN p >= 0.1 THEN 'Medium' ELSE 'Low' END AS risk_category, "
       "CAST(round_even(p * 100, 0) AS INT) AS score, 'ML pipeline day-level risk assessment: ' || CASE WHEN p >= 0.9984 THEN 'Critical' WHEN p >= 0.9926 THEN 'High' WHEN p >= 0.1 THEN 'Medium' ELSE 'Low' END || "
       "' (' || CAST(n AS VARCHAR) || ' events this day, driver event ' || event_id || '). ' || CASE WHEN p >= 0.9984 THEN 'Escalate to security (critical)' WHEN p >= 0.9926 THEN 'Flag for IT review' "
       "WHEN p >= 0.1 THEN 'Notify employee (educate)' ELSE 'No action / log only' END || '.' AS explanation FROM g WHERE p >= 0.02")
def m14(spark, sf):
    from wardlight.operators.features import live_matrix
    from wardlight.operators.read_models import live_driver_events

    days = flat_events(spark, sf).groupBy(F.col("username").alias("_username"), F.to_date("ts").alias("date")).agg(
        ((F.max("k") + 1) / 100.0).alias("classifier_score"))
    drivers = live_driver_events(live_matrix(canonical_events(spark, sf)))
    return nightly.user_day_results(days, drivers).select(
        "event_id", "_username", F.col("date").cast("string").alias("date"), "risk_category", "score",
        F.col("signals")[0]["explanation"].alias("explanation"))
