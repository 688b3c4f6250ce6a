"""Action tiers, remediation, alerts and read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from verification import sql as S
from verification.binding import canonical_events, flat_events, unified_events
from verification.core_queries import daily, risk
from verification.registry import query
from verification.scalar_queries import CE
from wardlight import fixed_values as fv
from wardlight.functions import rules
from wardlight.operators import alerts as AL
from wardlight.operators import read_models as RM
from wardlight.operators import tiers as T
from wardlight.operators.features import live_matrix

AS_OF = "2024-01-31 00:00:00"
EV = S.ctes(S.EV)
_CAT = ("CASE WHEN k >= 90 THEN 'Critical' WHEN k >= 70 THEN 'High' WHEN k >= 50 THEN 'Medium' WHEN k >= 30 THEN 'Low' ELSE 'Informational' END")
_TIER_IN = f"""ti AS (SELECT event_id, {_CAT} AS risk_category, k % 5 AS repeat_count, (k % 10) / 10.0 AS prev,
  k % 20 = 0 AS denied, k % 6 = 0 AS bad FROM ev),
t1 AS (SELECT *, {S.case_map('risk_category', fv.BASE_TIER)} AS base FROM ti),
t2 AS (SELECT *, risk_category <> 'Informational' AND prev >= 0.4 AND base <> 'R6' AS common, risk_category <> 'Informational' AND repeat_count >= 3 AS rep FROM t1),
t3 AS (SELECT *, CASE WHEN common THEN 'R4' WHEN rep THEN {S.case_map('base', fv.TIER_ABOVE)} ELSE base END AS step FROM t2)"""


@query("p31_action_tiers", S.ctes(S.EV, _TIER_IN) + f"""SELECT event_id, CASE WHEN denied THEN 'R6' WHEN bad AND step IN ('R1','R2','R3') THEN 'R5' ELSE step END AS r_tier,
  CASE WHEN denied THEN '{fv.DENIED_TEXT.replace("'", "''")}' ELSE 'risk_category=''' || risk_category || ''' -> base tier ' || base || ' (' || {S.case_map('base', fv.TIER_LABEL)} || ').' ||
  CASE WHEN common THEN ' peer_prevalence=' || CAST(CAST(round_even(prev * 100, 0) AS INT) AS VARCHAR) || '% >= 40% threshold -- {fv.PREVALENCE_TEXT}'
    WHEN rep THEN ' repeat_count=' || CAST(repeat_count AS VARCHAR) || ' >= 3 threshold -- escalated one step: ' || base || ' -> ' || step || '.' ELSE '' END ||
  CASE WHEN bad AND step IN ('R1','R2','R3') THEN ' is_known_bad_category=True (matched a Wazuh CDB list) -- raised floor from ' || step || ' to R5 regardless of statistical tier.' ELSE '' END
  END AS r_tier_explanation FROM t3""")
def p31(spark, sf):
    e = flat_events(spark, sf).select(
        "event_id", F.expr(_CAT).alias("risk_category"), (F.col("k") % 5).alias("repeat_count"),
        ((F.col("k") % 10) / 10.0).alias("peer_prevalence"),
        F.expr("CASE WHEN k % 20 = 0 THEN 'denied' WHEN k % 20 = 1 THEN 'confirmed' END").alias("self_audit_response"),
        (F.col("k") % 6 == 0).alias("is_known_bad_category"))
    return T.with_action_tier(e).select("event_id", "r_tier", "r_tier_explanation")


_SECTIONS = (("9.1", "Removable Storage", 1, "Rollout first", "Practice"), ("9.1", "Removable Storage", 2, "Allow list", "Verified"),
             ("9.1", "Removable Storage", 3, "Kiosk", "Practice"), ("9.3", "Unauthorized SaaS", 1, "Consent scan", "Verified"),
             ("9.4", "Personal cloud storage", 1, "Tenant rules", "Verified"), ("9.5", "Messaging", 1, "Sanctioned chat", "Practice"),
             ("9.5", "Messaging", 2, "Mail rules", "Verified"), ("9.6", "Shadow AI", 1, "Enterprise plan", "Practice"))


def remediation(spark):
    return spark.createDataFrame([(a, b, n, n, t, e) for a, b, n, t, e in _SECTIONS],
                                 "section_id string, section_title string, ord int, fix_no int, fix_title string, evidence_tier string")


_REM = ("rem AS (SELECT * FROM (VALUES " + ", ".join(repr(r) for r in _SECTIONS) + ") t(section_id, section_title, fix_no, fix_title, tier)), "
        "rsec AS (SELECT section_id, any_value(section_title) AS section_title, string_agg(fix_title, '; ' ORDER BY fix_no) FILTER (WHERE fix_no <= 2) AS fixes, "
        "min_by(fix_title, fix_no) AS first_fix FROM rem GROUP BY section_id)")
_J8 = f"""j0 AS (SELECT rs.*, _source = 'casb' AND shadow_it_category IS NOT NULL AS by_cat,
  CASE WHEN _source = 'casb' AND shadow_it_category IS NOT NULL THEN {S.case_map('shadow_it_category', fv.CATEGORY_SECTION)}
  ELSE {S.case_map('cert_signal', fv.SIGNAL_SECTION)} END AS section_id FROM rs),
j8 AS (SELECT j0.*, section_title, fixes, first_fix, CASE WHEN by_cat AND j0.section_id IS NULL THEN 'unknown_category' WHEN NOT by_cat AND cert_signal IS NULL THEN 'no_signal'
  WHEN section_title IS NULL THEN 'section_not_found' ELSE 'ok' END AS status FROM j0 LEFT JOIN rsec USING (section_id))"""
REMEDY = S.ctes(S.EV, S.FM, S.UB, S.SS, S.DEV, S.SC, S.DAY, _REM, _J8)


def advised(spark, sf, frame=None):
    return T.attach_remediation(frame if frame is not None else daily(spark, sf), remediation(spark), "casb")


@query("j8_remediation", REMEDY + "SELECT _username, _source, CAST(date AS VARCHAR) AS date, status AS recommendation_status, section_title AS recommended_section, "
       "fixes AS recommended_fixes FROM j8")
def j8(spark, sf):
    return advised(spark, sf).select(
        "_username", "_source", F.col("date").cast("string").alias("date"), "recommendation_status", "recommended_section",
        F.array_join(F.col("recommended_fixes.title"), "; ").alias("recommended_fixes"))


@query("l5_first_fixes", "SELECT n.n_nationkey AS section_id, string_agg(s_name, '; ' ORDER BY s_suppkey) AS fixes FROM nation n JOIN "
       "(SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) s ON s.s_nationkey = n.n_nationkey WHERE rn <= 2 GROUP BY ALL")
def l5(spark, sf):
    from verification.binding import table

    rows = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("section_id"), F.lit("x").alias("section_title"), F.col("s_suppkey").alias("ord"),
        F.col("s_name").alias("fix_title"), F.lit("y").alias("evidence_tier"))
    return T.section_fixes(rows).select("section_id", F.array_join(F.col("fixes.title"), "; ").alias("fixes"))


def tiered(spark, sf):
    return T.with_action_tier(advised(spark, sf, risk(spark, sf)))


_AL_TIER = S.case_map("risk_category", fv.BASE_TIER)
_DAY_ALERTS = REMEDY + f"""SELECT 'AL-' || substr(sha1(_username || '-' || CAST(date AS VARCHAR) || '-' || _source), 1, 12) AS id, _username AS "userId",
  lower(risk_category) AS severity, CAST(round_even(round_even(pct, 1), 0) AS INT) AS score, coalesce(shadow_it_category, CASE cert_signal WHEN 'is_removable_media' THEN 'Is Removable Media'
  WHEN 'external_recipient' THEN 'External Recipient' WHEN 'is_exfil_domain' THEN 'Is Exfil Domain' END, 'Unclassified activity') AS app,
  CAST(date AS VARCHAR) || 'T00:00:00Z' AS "createdAt", {_AL_TIER} AS tier,
  {S.case_map('risk_category', {k: fv.TIER_LABEL[v] for k, v in fv.BASE_TIER.items()})} || '.' || coalesce(' ' || first_fix || '.', '') AS recommendation
  FROM j8 WHERE risk_category <> 'Informational' AND {_AL_TIER} <> 'R1'"""


@query("p36_day_alerts", _DAY_ALERTS)
def p36(spark, sf):
    return AL.day_alerts(tiered(spark, sf)).select("id", "userId", "severity", "score", "app", "createdAt", "tier", "recommendation")


@query("p35_recommendation_sentence", REMEDY + f"SELECT _username, _source, CAST(date AS VARCHAR) AS date, "
       f"{S.case_map('risk_category', {k: fv.TIER_LABEL[v] for k, v in fv.BASE_TIER.items()})} || '.' || coalesce(' ' || first_fix || '.', '') AS recommendation FROM j8")
def p35(spark, sf):
    return tiered(spark, sf).select("_username", "_source", F.col("date").cast("string").alias("date"),
                                    AL.recommendation_sentence().alias("recommendation"))


@query("p34_evidence", EV + "SELECT event_id, CAST(n AS INT) AS n, label, detail FROM (SELECT event_id, 0 AS n, 'Weak authentication method' AS label, "
       "'Access used a weak or non-standard authentication method (deviation 0.' || CAST(k % 9 + 1 AS VARCHAR) || ').' AS detail FROM ev UNION ALL "
       "SELECT event_id, 1, 'Et Login Event', 'Feature ''et_login_event'' deviation: 0.5.' FROM ev WHERE k % 2 = 0)")
def p34(spark, sf):
    e = flat_events(spark, sf).withColumn("t", F.expr(
        "concat('weak_auth=0.', k % 9 + 1, CASE WHEN k % 2 = 0 THEN '; et_login_event=0.5' ELSE '' END)"))
    e = e.withColumn("contributors", AL.parse_contributors("t"))
    items = e.select("event_id", F.posexplode(AL.evidence_items("contributors", F.lit("00:00"))).alias("n", "x"))
    return items.select("event_id", "n", "x.label", "x.detail")


def score_rows(spark, sf):
    """Two score versions per event (the later one counts); some events have none."""
    e = flat_events(spark, sf).where(F.col("k") % 10 != 9)
    first = e.select("event_id", F.lit(1).alias("score"), F.col("ts").alias("computed_at"), "k")
    last = e.select("event_id", F.col("k").alias("score"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("computed_at"), "k")
    rows = first.unionByName(last).withColumn("severity", rules.event_severity("score"))
    signals = F.expr("CASE WHEN k % 3 = 0 THEN array(named_struct('signal', 'time_anomaly', 'explanation', 'late')) "
                     "ELSE CAST(array() AS ARRAY<STRUCT<signal:STRING,explanation:STRING>>) END")
    return (rows.withColumn("tier", rules.event_tier("score", "severity"))
            .withColumn("recommendation", F.concat(F.lit("act "), F.col("score").cast("string")))
            .withColumn("signals", signals).drop("k"))


def status_rows(spark, sf):
    e = flat_events(spark, sf)
    first = e.where(F.col("k") % 4 == 0).select("event_id", F.lit("under_review").alias("status"),
                                                (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("reviewed_at"))
    last = e.where(F.col("k") % 8 == 0).select("event_id", F.lit("resolved").alias("status"),
                                               (F.col("ts") + F.expr("INTERVAL 30 HOURS")).alias("reviewed_at"))
    return first.unionByName(last)


def event_alerts(spark, sf):
    return AL.event_alerts(canonical_events(spark, sf),
                           AL.latest_by(score_rows(spark, sf), ["event_id"], [F.desc("computed_at")]),
                           AL.latest_by(status_rows(spark, sf), ["event_id"], [F.desc("reviewed_at")]))


_APP = ("coalesce(rule, CASE kind WHEN 'file_upload' THEN 'File Upload' WHEN 'dlp_outcome' THEN 'Dlp Outcome' WHEN 'file_integrity' THEN 'File Integrity' END)")
_SEVK = "CASE WHEN k % 10 = 9 THEN 'low' WHEN k >= 90 THEN 'critical' WHEN k >= 70 THEN 'high' WHEN k >= 40 THEN 'medium' ELSE 'low' END"
ALQ = f"""al AS (SELECT event_id AS id, username AS "userId", {_SEVK} AS severity, CASE WHEN k % 10 = 9 THEN 0 ELSE k END AS score, {_APP} AS app, kind AS category,
  CASE WHEN k % 8 = 0 THEN 'resolved' WHEN k % 4 = 0 THEN 'under_review' ELSE 'new' END AS status, ts AS "createdAt",
  CASE WHEN k % 10 = 9 OR k = 0 THEN 'R1' ELSE {S.case_map(_SEVK, fv.ORCHESTRATED_TIER)} END AS tier,
  CASE WHEN k % 10 = 9 THEN '{fv.NOT_SCORED_TEXT}' ELSE 'act ' || CAST(k AS VARCHAR) END AS recommendation, 1 + CAST(k % 10 <> 9 AND k % 3 = 0 AS INT) AS n_evidence,
  CASE WHEN k % 8 = 0 THEN ts + INTERVAL 30 HOUR WHEN k % 4 = 0 THEN ts + INTERVAL 1 HOUR END AS reviewed_at FROM ce)"""
ALERTS = S.ctes(S.EV, CE, ALQ)
_ROW = 'id, "userId", severity, score, app, category, status, epoch_us("createdAt") AS created_us, tier'


def row_columns():
    return ["id", "userId", "severity", "score", "app", "category", "status",
            F.unix_micros("createdAt").alias("created_us"), "tier"]


@query("p37_event_alerts", ALERTS + f"SELECT {_ROW}, recommendation, n_evidence FROM al")
def p37(spark, sf):
    return event_alerts(spark, sf).select(*row_columns(), "recommendation", F.size("evidence").alias("n_evidence"))


@query("j12_status_and_score", ALERTS + 'SELECT id, status, score, epoch_us(reviewed_at) AS reviewed_us FROM al')
def j12(spark, sf):
    return event_alerts(spark, sf).select("id", "status", "score", F.unix_micros("reviewed_at").alias("reviewed_us"))


@query("w9_latest_status", EV + "SELECT event_id, CASE WHEN k % 8 = 0 THEN 'resolved' ELSE 'under_review' END AS status FROM ev WHERE k % 4 = 0")
def w9(spark, sf):
    return AL.latest_by(status_rows(spark, sf), ["event_id"], [F.desc("reviewed_at")]).select("event_id", "status")


@query("p40_alert_search", ALERTS + f"SELECT {_ROW} FROM al WHERE contains(lower(app), 'logon') AND severity = 'high' AND status = 'new'")
def p40(spark, sf):
    return AL.search_alerts(event_alerts(spark, sf), "LOGON", "high", "new").select(*row_columns())


@query("l1_top_risk", ALERTS + f"SELECT {_ROW} FROM al ORDER BY score DESC, id LIMIT 3")
def l1(spark, sf):
    return AL.top_risk(event_alerts(spark, sf)).select(*row_columns())


@query("l2_alert_page", ALERTS + f'SELECT {_ROW}, (SELECT count(*) FROM al) AS total FROM al ORDER BY "createdAt" DESC, id LIMIT 5 OFFSET 10')
def l2(spark, sf):
    return AL.alert_page(event_alerts(spark, sf), page=3).select(*row_columns(), "total")


@query("p41_related_alerts", ALERTS + ', o AS (SELECT "userId", max_by(id, row(score, id)) AS opened_id FROM al GROUP BY 1) '
       'SELECT opened_id, id, al."userId" FROM al JOIN o USING ("userId") WHERE id <> opened_id')
def p41(spark, sf):
    a = event_alerts(spark, sf).select("id", "userId", "score")
    opened = a.groupBy("userId").agg(F.max_by("id", F.struct("score", "id")).alias("id"))
    return AL.related_alerts(a, opened).select("opened_id", "id", "userId")


@query("a12_severity_counts", ALERTS + "SELECT " + ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in fv.SEVERITIES)
       + ", count(*) FILTER (WHERE category = 'file_integrity') AS file_integrity, count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) AS total FROM al")
def a12(spark, sf):
    return RM.severity_counts(event_alerts(spark, sf))


@query("a12_new_apps", ALERTS + """SELECT count(*) FILTER (WHERE f >= TIMESTAMP '2024-01-24 00:00:00') AS new_apps FROM (SELECT app, min("createdAt") AS f FROM al GROUP BY app)""")
def a12n(spark, sf):
    return RM.new_apps(event_alerts(spark, sf), AS_OF)


@query("a13_daily_trend", ALERTS + """, g AS (SELECT CAST(dd AS DATE) AS day, s AS series FROM generate_series(TIMESTAMP '2024-01-25', TIMESTAMP '2024-01-31', INTERVAL 1 DAY) x(dd),
  unnest(['low','medium','high','critical','reviewed']) y(s)), c AS (SELECT CAST("createdAt" AS DATE) AS day, severity AS series FROM al UNION ALL
  SELECT CAST(reviewed_at AS DATE), 'reviewed' FROM al WHERE reviewed_at IS NOT NULL)
  SELECT CAST(g.day AS VARCHAR) AS day, g.series, count(c.day) AS n FROM g LEFT JOIN c ON g.day = c.day AND g.series = c.series GROUP BY g.day, g.series""")
def a13(spark, sf):
    return RM.daily_trend(event_alerts(spark, sf), AS_OF).select(F.col("day").cast("string").alias("day"), "series", "n")


@query("a14_application_inventory", ALERTS + 'SELECT app, min_by(category, "createdAt") AS category, count(DISTINCT "userId") AS active_users FROM al GROUP BY app')
def a14(spark, sf):
    return RM.application_inventory(event_alerts(spark, sf))


@query("a15_leaderboard", ALERTS + 'SELECT "userId", count(*) AS alert_count, max(score) AS max_score, max_by(severity, score) AS top_severity FROM al GROUP BY 1')
def a15(spark, sf):
    return RM.leaderboard(event_alerts(spark, sf))


@query("a16_user_trends", ALERTS + ', r AS (SELECT *, row_number() OVER (PARTITION BY "userId" ORDER BY "createdAt" DESC, id DESC) AS n FROM al) '
       """SELECT "userId", string_agg(CAST(score AS VARCHAR), ',' ORDER BY n DESC) AS trend FROM r WHERE n <= 6 GROUP BY 1""")
def a16(spark, sf):
    return RM.user_trends(event_alerts(spark, sf)).select("userId", F.array_join("trend", ",").alias("trend"))


@query("a16_user_inventory", ALERTS + 'SELECT DISTINCT "userId", app FROM al')
def a16i(spark, sf):
    return RM.user_inventory(event_alerts(spark, sf))


@query("a16_user_alerts", ALERTS + f"SELECT {_ROW} FROM al")
def a16a(spark, sf):
    return RM.user_alerts(event_alerts(spark, sf)).select(*row_columns())


@query("a17_policy_triggers", ALERTS + """, g AS (SELECT category, count(DISTINCT "userId") AS affected_users, count(*) AS total_alerts,
  count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'critical') AS critical FROM al WHERE "createdAt" >= TIMESTAMP '2024-01-24' GROUP BY category),
  d AS (SELECT *, CASE greatest(low, medium, high, critical) WHEN low THEN 'low' WHEN medium THEN 'medium' WHEN high THEN 'high' ELSE 'critical' END AS dominant_severity FROM g)
  SELECT *, CAST(affected_users AS VARCHAR) || ' employee' || CASE WHEN affected_users = 1 THEN '' ELSE 's' END || ' flagged for ' || category || ' usage this week, mostly ' ||
  dominant_severity || ' severity.' AS summary, 'Route to manual triage' AS action FROM d""")
def a17(spark, sf):
    return RM.policy_triggers(event_alerts(spark, sf), AS_OF)


_APPROVAL = ("CASE WHEN k % 10 IN (2, 3, 7) THEN 'sanctioned' WHEN k % 10 IN (0, 4) THEN 'unapproved' ELSE 'review' END")


@query("a18_approval_mix", EV + f"SELECT category, CAST(sum(CASE WHEN approval = 'sanctioned' THEN active_users ELSE 0 END) AS BIGINT) AS safe, "
       "CAST(sum(CASE WHEN approval <> 'sanctioned' THEN active_users ELSE 0 END) AS BIGINT) AS untrusted, CAST(sum(active_users) AS BIGINT) AS total, "
       "CAST(round(100.0 * sum(CASE WHEN approval = 'sanctioned' THEN active_users ELSE 0 END) / sum(active_users)) AS INT) AS safe_percent "
       f"FROM (SELECT event_type AS category, domain, {_APPROVAL} AS approval, count(DISTINCT username) AS active_users FROM ev WHERE domain IS NOT NULL GROUP BY ALL) GROUP BY category")
def a18(spark, sf):
    e = flat_events(spark, sf).where("domain IS NOT NULL").select(
        F.col("event_type").alias("category"), "domain", F.expr(_APPROVAL).alias("approval"), "username").distinct()
    apps = e.groupBy("category", "domain", "approval").agg(F.count(F.lit(1)).alias("active_users"))
    return RM.approval_mix(apps)


@query("a19_severity_mix", ALERTS + "SELECT severity, count(*) AS n FROM al GROUP BY severity")
def a19(spark, sf):
    return RM.value_mix(event_alerts(spark, sf), "severity")


@query("a19_evidence_mix", ALERTS + "SELECT 'observed' AS strength, CAST(sum(n_evidence) AS BIGINT) AS n FROM al")
def a19e(spark, sf):
    items = event_alerts(spark, sf).select(F.explode("evidence").alias("x")).select("x.strength")
    return RM.value_mix(items, "strength")


@query("a22_category_distribution", S.RISK + "SELECT risk_category, count(*) AS n FROM rs GROUP BY risk_category")
def a22(spark, sf):
    return RM.value_mix(risk(spark, sf), "risk_category")


@query("l6_apps_by_users", ALERTS + 'SELECT app, count(DISTINCT "userId") AS active_users FROM al GROUP BY app ORDER BY active_users DESC, app')
def l6(spark, sf):
    return RM.application_inventory(event_alerts(spark, sf)).select("app", "active_users")


_ACT_CAT = "CASE k % 4 WHEN 0 THEN 'Shadow AI' WHEN 1 THEN 'Personal cloud' WHEN 2 THEN 'Unauthorized SaaS' ELSE 'Other' END"


@query("j18_standing_actions", EV + f"SELECT event_id, {S.case_map(_ACT_CAT, fv.STANDING_ACTION, fv.DEFAULT_STANDING_ACTION)} AS action FROM ev")
def j18(spark, sf):
    return flat_events(spark, sf).select("event_id", rules.standing_action(F.expr(_ACT_CAT)).alias("action"))


@query("a7_live_driver", S.ctes(S.EV, CE) + "SELECT username AS _username, CAST(d AS VARCHAR) AS date, max_by(event_id, row(rule_level, ts)) AS driver_event_id, "
       "count(*) AS n_events FROM ce GROUP BY ALL")
def a7(spark, sf):
    return RM.live_driver_events(live_matrix(canonical_events(spark, sf))).select(
        "_username", F.col("date").cast("string").alias("date"), "driver_event_id", "n_events")


_halves = """h0 AS (SELECT username, k AS risk_score, row_number() OVER (PARTITION BY username ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY username) AS n FROM ev WHERE k % 11 <> 0),
h1 AS (SELECT username, any_value(n) AS n_scored, avg(risk_score) AS mean_score, avg(risk_score) FILTER (WHERE p < n // 2) AS early_mean,
  avg(risk_score) FILTER (WHERE p >= n // 2) AS late_mean FROM h0 GROUP BY username),
h2 AS (SELECT *, CASE WHEN n_scored < 4 THEN 'stable' WHEN late_mean > early_mean * 1.15 THEN 'rising' WHEN late_mean < early_mean * 0.85 THEN 'falling' ELSE 'stable' END AS risk_trend FROM h1)"""


@query("w6_half_over_half", S.ctes(S.EV, _halves) + "SELECT username, n_scored, round(early_mean, 6) AS early_mean, round(late_mean, 6) AS late_mean, risk_trend FROM h2")
def w6(spark, sf):
    return RM.risk_halves(unified_events(spark, sf)).select(
        "username", "n_scored", F.round("early_mean", 6).alias("early_mean"), F.round("late_mean", 6).alias("late_mean"), "risk_trend")


def employees(spark, sf):
    from verification.binding import table

    c = table(spark, sf, "customer")
    return c.select(F.concat(F.lit("user-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("user_id"),
                    F.col("c_mktsegment").alias("department"),
                    F.when(F.col("c_custkey") % 7 == 0, "None").otherwise("analyst").alias("role"))


@query("a11_user_profiles", S.ctes(S.EV, _halves) + ", a AS (SELECT username, count(*) AS n, list_sort(list_distinct(list(hour(ts)))) AS hrs, "
       "count(*) FILTER (WHERE policy_violation = 1) AS total_alerts, max(ts) AS last_seen FROM ev GROUP BY username), "
       "c AS (SELECT 'user-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS username, c_mktsegment AS department, CASE WHEN c_custkey % 7 <> 0 THEN 'analyst' END AS role FROM customer) "
       "SELECT username, department, role, round_even(coalesce(n, 0) / 90.0, 3) AS avg_daily_events, coalesce(array_to_string(hrs, ','), '') AS typical_hours, "
       "round_even(coalesce(mean_score, 0), 1) AS current_risk_score, coalesce(risk_trend, 'stable') AS risk_trend, coalesce(total_alerts, 0) AS total_alerts, "
       "epoch_us(last_seen) AS last_seen_us FROM c LEFT JOIN a USING (username) LEFT JOIN h2 USING (username)")
def a11(spark, sf):
    p = RM.user_profiles(unified_events(spark, sf), employees(spark, sf))
    return p.select("username", "department", "role", "avg_daily_events", F.array_join("typical_hours", ",").alias("typical_hours"),
                    "current_risk_score", "risk_trend", "total_alerts", F.unix_micros("last_seen").alias("last_seen_us"))


@query("a11_profile_items", EV + "SELECT DISTINCT username, 'domain' AS kind, domain AS item FROM ev WHERE domain IS NOT NULL AND coalesce(is_shadow_it, 0) = 0 UNION ALL "
       "SELECT DISTINCT username, 'app', app_name FROM ev WHERE app_name IS NOT NULL AND sanction_status = 'Sanctioned'")
def a11i(spark, sf):
    return RM.profile_items(unified_events(spark, sf))


@query("j16_employees_with_events", EV + ", a AS (SELECT username, count(*) AS n FROM ev GROUP BY username) SELECT 'user-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS username, "
       "a.n IS NOT NULL AS has_events FROM customer LEFT JOIN a ON a.username = 'user-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0')")
def j16(spark, sf):
    p = RM.user_profiles(unified_events(spark, sf), employees(spark, sf))
    return p.select("username", F.col("last_seen").isNotNull().alias("has_events"))


def heartbeats(spark, sf):
    e = flat_events(spark, sf)
    return e.select(F.col("client_id").alias("tenant_id"), F.when(F.col("k") % 10 == 0, "error").otherwise("ok").alias("status"),
                    F.col("k").alias("events_found"), F.lit(None).cast("string").alias("detail"), F.col("ts").alias("polled_at"))


@query("w8_latest_heartbeat", EV + "SELECT client_id AS tenant_id, max_by(CASE WHEN k % 10 = 0 THEN 'error' ELSE 'ok' END, ts) AS status, max_by(k, ts) AS events_found, "
       "epoch_us(max(ts)) AS polled_us FROM ev GROUP BY client_id")
def w8(spark, sf):
    return RM.latest_heartbeat(heartbeats(spark, sf)).select("tenant_id", "status", "events_found", F.unix_micros("polled_at").alias("polled_us"))


@query("p39_heartbeat_state", EV + "SELECT event_id, CASE WHEN k % 10 = 0 OR k * 2 > 150 THEN 'down' WHEN k % 2 = 0 THEN 'live' ELSE 'healthy-idle' END AS state FROM ev")
def p39(spark, sf):
    e = flat_events(spark, sf)
    return e.select("event_id", rules.heartbeat_state(
        F.when(F.col("k") % 10 == 0, "error").otherwise("ok"), F.col("ts"), F.col("ts"),
        F.expr("CASE WHEN k % 2 = 0 THEN ts - INTERVAL 1 MINUTE ELSE ts END"),
        F.expr("ts + make_dt_interval(0, 0, 0, k * 2)")).alias("state"))


@query("flow_events_to_alerts", _DAY_ALERTS)
def flow(spark, sf):
    from wardlight.plans import batch

    e = unified_events(spark, sf).withColumn("input_ord", F.unix_micros("timestamp"))
    result = batch.run(spark, e, remediation(spark), casb_source="casb")
    return result.alerts.select("id", "userId", "severity", "score", "app", "createdAt", "tier", "recommendation")
