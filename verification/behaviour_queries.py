"""Robust baselines, catalogue, detectors and their combination."""

from __future__ import annotations

from pyspark.sql import functions as F

from verification import sql as S
from verification.binding import flat_events, security_events
from verification.core_queries import r6
from verification.registry import query
from verification.scalar_queries import _KEY, _pad
from wardlight import fixed_values as fv
from wardlight.operators import catalogue, detect, robust

SE = """se AS (SELECT event_id, username AS user_id, department, ts AS occurred_at, d, CASE event_type WHEN 'login_event' THEN 'login'
  WHEN 'cloud_upload' THEN 'transfer' ELSE 'activity' END AS event_type, bytes_sent AS bytes_transferred, domain,
  hour(ts) * 60 + minute(ts) AS mi FROM ev)"""
HIST = "hs AS (SELECT * FROM se WHERE occurred_at < TIMESTAMP '2024-01-22')"
_DIST = "abs((({a} - {b} + 720) % 1440 + 1440) % 1440 - 720)"
RB = f"""ud AS (SELECT user_id, d, sum(bytes_transferred) AS b FROM hs GROUP BY ALL),
um AS (SELECT user_id, median(b) AS daily_volume_median, count(*) AS sample_days FROM ud GROUP BY user_id),
ux AS (SELECT user_id, CASE WHEN count(*) < 2 THEN 1.0 ELSE greatest(1.4826 * median(abs(b - daily_volume_median)), 1.0) END AS daily_volume_scale
  FROM ud JOIN um USING (user_id) GROUP BY user_id),
dp AS (SELECT user_id, max_by(department, occurred_at) AS department FROM hs GROUP BY user_id),
lc AS (SELECT user_id, mi, min(occurred_at) AS ft FROM hs WHERE event_type = 'login' GROUP BY ALL),
co AS (SELECT lc.user_id, lc.mi, lc.ft, sum({_DIST.format(a='h.mi', b='lc.mi')}) AS cost
  FROM lc JOIN hs h ON h.user_id = lc.user_id AND h.event_type = 'login' GROUP BY ALL),
ce1 AS (SELECT user_id, min_by(mi, row(cost, ft)) AS c FROM co GROUP BY user_id),
ld AS (SELECT h.user_id, c, {_DIST.format(a='h.mi', b='c')} AS dist FROM hs h JOIN ce1 USING (user_id) WHERE h.event_type = 'login'),
lm AS (SELECT user_id, median(dist) AS m, count(*) AS login_samples FROM ld GROUP BY user_id),
lp AS (SELECT ld.user_id, c / 60.0 AS login_hour_centre, any_value(login_samples) AS login_samples, CASE WHEN count(*) < 2 THEN 1.0
  ELSE greatest(1.4826 * median(abs(dist - m)) / 60.0, 1.0) END AS login_hour_scale FROM ld JOIN lm USING (user_id) GROUP BY ld.user_id, c),
ub2 AS (SELECT um.*, daily_volume_scale, department, login_hour_centre, login_hour_scale, coalesce(login_samples, 0) AS login_samples
  FROM um JOIN ux USING (user_id) JOIN dp USING (user_id) LEFT JOIN lp USING (user_id)),
pm AS (SELECT department, median(daily_volume_median) AS m, count(*) AS cohort_size FROM ub2 GROUP BY department),
pb AS (SELECT department, m AS daily_volume_median, cohort_size, CASE WHEN cohort_size < 2 THEN 1.0 ELSE
  greatest(1.4826 * median(abs(daily_volume_median - m)), 1.0) END AS daily_volume_scale FROM ub2 JOIN pm USING (department) GROUP BY department, m, cohort_size),
kd AS (SELECT DISTINCT user_id, domain FROM hs WHERE domain IS NOT NULL)"""
ROBUST = S.ctes(S.EV, SE, HIST, RB)
ROBUST_ALL = S.ctes(S.EV, SE, "hs AS (SELECT * FROM se)", RB)


def history(spark, sf):
    """Events before the baseline's reference day; every event is evaluated against it."""
    return security_events(spark, sf).where(F.col("occurred_at") < F.lit("2024-01-22").cast("timestamp"))


def baselines(spark, sf, h=None):
    h = history(spark, sf) if h is None else h
    users = robust.robust_user_baselines(h)
    return users, robust.peer_baselines(users), robust.known_domains(h, _KEY)


_SPREADS = ("daily_volume_median", "daily_volume_scale", "login_hour_centre", "login_hour_scale")


@query("a8_robust_user_baselines", ROBUST_ALL + f"SELECT user_id, department, sample_days, login_samples, {S.r6(*_SPREADS)} FROM ub2")
def a8(spark, sf):
    return baselines(spark, sf, security_events(spark, sf))[0].select("user_id", "department", "sample_days", "login_samples", *r6(*_SPREADS))


@query("a8_known_domains", ROBUST_ALL + f"SELECT user_id, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(domain)))) AS domain_token FROM kd")
def a8k(spark, sf):
    return baselines(spark, sf, security_events(spark, sf))[2]


@query("a9_login_medoid", ROBUST_ALL + f"SELECT user_id, login_samples, {S.r6('login_hour_centre', 'login_hour_scale')} FROM lp")
def a9(spark, sf):
    return robust.login_pattern(robust.login_cells(security_events(spark, sf))).select(
        "user_id", "login_samples", *r6("login_hour_centre", "login_hour_scale"))


@query("a10_peer_baselines", ROBUST_ALL + f"SELECT department, cohort_size, {S.r6('daily_volume_median', 'daily_volume_scale')} FROM pb")
def a10(spark, sf):
    return baselines(spark, sf, security_events(spark, sf))[1].select("department", "cohort_size", *r6("daily_volume_median", "daily_volume_scale"))


@query("w10_last_department", ROBUST_ALL + "SELECT user_id, department FROM dp")
def w10(spark, sf):
    days = robust.user_days(security_events(spark, sf))
    return days.groupBy("user_id").agg(F.max_by("department", F.struct("last_us", "department")).alias("department"))


_CAT = ((0, "ChatGPT", "chatgpt.com", "ai", "conditional", 10), (1, "Dropbox", "dropbox.com", "cloud_storage", "unapproved", 25),
        (2, "Google Drive", "drive.google.com", "cloud_storage", "approved", 5), (3, "Slack", "slack.com", "collaboration", "approved", 5),
        (4, "Perplexity", "perplexity.ai", "ai", "unapproved", 15), (5, "Files", "files.slack.com", "cloud_storage", "conditional", 8),
        (6, "GitHub", "github.com", "development", "approved", 2))
CAT = "cat AS (SELECT * FROM (VALUES " + ", ".join(repr(r) for r in _CAT) + ") t(ord, name, domain, category, approval_state, risk_weight))"
APP = """da AS (SELECT e.domain, min(cat.ord) AS ord FROM (SELECT DISTINCT domain FROM ev WHERE domain IS NOT NULL) e JOIN cat
  ON e.domain = cat.domain OR ends_with(e.domain, '.' || cat.domain) GROUP BY e.domain)"""


def app_catalogue(spark):
    return spark.createDataFrame(list(_CAT), "ord int, name string, domain string, category string, approval_state string, "
                                 "risk_weight int").withColumn("publisher", F.lit(None).cast("string"))


@query("j9_catalogue_match", S.ctes(S.EV, CAT, APP) + "SELECT event_id, cat.name AS app, cat.category, cat.approval_state, cat.risk_weight FROM ev "
       "LEFT JOIN da ON ev.domain = da.domain LEFT JOIN cat ON da.ord = cat.ord")
def j9(spark, sf):
    rows = catalogue.with_app(flat_events(spark, sf).select("event_id", "domain"), app_catalogue(spark))
    return rows.select("event_id", F.col("app.name").alias("app"), "app.category", "app.approval_state", "app.risk_weight")


@query("j9_page_hosts", "WITH p AS (SELECT page_id, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '') AS host FROM pages), "
       "cat AS (SELECT row_number() OVER (ORDER BY min(page_id)) - 1 AS ord, suffix FROM (SELECT page_id, regexp_extract(host, '[^.]+[.][^.]+$') AS suffix FROM p) "
       "WHERE suffix <> '' GROUP BY suffix) SELECT p.page_id, cat.suffix AS app FROM p LEFT JOIN cat ON p.host = cat.suffix OR ends_with(p.host, '.' || cat.suffix)")
def j9_pages(spark, sf):
    from verification.binding import table
    from wardlight.functions.text import url_authority

    p = table(spark, sf, "pages").select("page_id", url_authority("url").alias("domain"))
    suffix = F.regexp_extract("domain", "[^.]+[.][^.]+$", 0)
    cat = (p.select(suffix.alias("domain"), "page_id").where(F.col("domain") != "").groupBy("domain")
           .agg(F.min("page_id").alias("ord")).select(
               "ord", F.col("domain").alias("name"), "domain", F.lit(None).cast("string").alias("publisher"),
               F.lit("web").alias("category"), F.lit("approved").alias("approval_state"), F.lit(0).alias("risk_weight")))
    return catalogue.with_app(p, cat).select("page_id", F.col("app.name").alias("app"))


def engine_rows(spark, sf):
    users, peers, known = baselines(spark, sf)
    return detect.attach_baselines(security_events(spark, sf), users, peers, known, _KEY)


_Z = "CAST(least(100, greatest(0, round_even(({z} - 2) * 25, 0))) AS INT)"
AT = f"""atb AS (SELECT se.*, ub2.user_id IS NOT NULL AS has, sample_days, login_samples, ub2.login_hour_centre,
  {_DIST.format(a='se.mi', b='(login_hour_centre * 60)')} / 60.0 / login_hour_scale AS zt,
  abs(bytes_transferred - ub2.daily_volume_median) / ub2.daily_volume_scale AS zv, kd.user_id IS NOT NULL AS known,
  abs(bytes_transferred - pb.daily_volume_median) / pb.daily_volume_scale AS zp, cohort_size
FROM se LEFT JOIN ub2 ON se.user_id = ub2.user_id LEFT JOIN pb ON se.department = pb.department
  LEFT JOIN kd ON se.user_id = kd.user_id AND se.domain = kd.domain),
en AS (SELECT *, CASE WHEN has AND event_type = 'login' AND login_hour_centre IS NOT NULL AND round(zt, 9) >= 3 THEN {_Z.format(z='round(zt, 9)')} END AS s_time,
  CASE WHEN has AND event_type IN ('activity', 'transfer') AND bytes_transferred > 0 AND zv >= 3 THEN {_Z.format(z='zv')} END AS s_volume,
  CASE WHEN has AND domain IS NOT NULL AND NOT known THEN 35 END AS s_domain,
  CASE WHEN has AND bytes_transferred > 0 AND cohort_size >= 5 AND zp >= 3 THEN {_Z.format(z='zp')} END AS s_peer FROM atb),
ef AS (SELECT *, greatest(coalesce(s_time, 0), coalesce(s_volume, 0), coalesce(s_domain, 0), coalesce(s_peer, 0)) AS top,
  CASE WHEN sample_days > 0 THEN round_even(least(1.0, 0.4 + 0.6 * least(sample_days, 7) / 7), 2) ELSE 0 END AS confidence FROM en)"""
ENGINE = S.ctes(S.EV, SE, HIST, RB, AT)


def _signals(*cols):
    parts = ", ".join(f"'{n}:' || CAST({c} AS VARCHAR)" for n, c in cols)
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), '|')"


def signal_text(column="signals"):
    return F.array_join(F.transform(column, lambda s: F.concat(s["signal"], F.lit(":"), s["score"].cast("string"))), "|")


def _engine_query(name, column, index):
    sig = {"time_anomaly": "s_time", "volume_anomaly": "s_volume", "new_domain": "s_domain", "peer_comparison": "s_peer"}

    @query(name, ENGINE + f"SELECT event_id, user_id, {sig[column]} AS score FROM en WHERE {sig[column]} IS NOT NULL")
    def run(spark, sf):
        rows = engine_rows(spark, sf).withColumn("s", detect.behaviour_signals("engine")[index])
        return rows.where(F.col("s").isNotNull()).select("event_id", "user_id", F.col("s.score").alias("score"))
    return run


m4 = _engine_query("m4_time_anomaly", "time_anomaly", 0)
m5 = _engine_query("m5_volume_anomaly", "volume_anomaly", 1)
m6 = _engine_query("m6_new_domain", "new_domain", 2)
m7 = _engine_query("m7_peer_comparison", "peer_comparison", 3)


@query("u4_unknown_tokens", ENGINE + "SELECT event_id, domain FROM atb WHERE domain IS NOT NULL AND NOT known")
def u4(spark, sf):
    return engine_rows(spark, sf).where("domain_token IS NOT NULL AND domain_known IS NULL").select("event_id", "domain")


@query("j13_stored_baselines", ENGINE + "SELECT event_id, has, sample_days, known, cohort_size FROM atb")
def j13(spark, sf):
    return engine_rows(spark, sf).select(
        "event_id", F.coalesce("has_baseline", F.lit(False)).alias("has"), "sample_days",
        F.coalesce("domain_known", F.lit(False)).alias("known"), "cohort_size")


@query("m10_signals", ENGINE + "SELECT event_id, " + _signals(("time_anomaly", "s_time"), ("volume_anomaly", "s_volume"),
       ("new_domain", "s_domain"), ("peer_comparison", "s_peer")) + " AS signals FROM en")
def m10(spark, sf):
    rows = detect.with_signals(engine_rows(spark, sf), detect.behaviour_signals("engine"))
    return rows.select("event_id", signal_text().alias("signals"))


_sev = "CASE WHEN score >= 90 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END"
_expl = " ".join(f"WHEN {c} = top THEN '{fv.EXPLANATION[n]}'".replace("user's", "user''s").replace("this user''", "this user''")
                 for n, c in (("time_anomaly", "s_time"), ("volume_anomaly", "s_volume"), ("new_domain", "s_domain"), ("peer_comparison", "s_peer")))


@query("m11_event_verdicts", ENGINE + ", sc2 AS (SELECT *, CAST(round_even(top * confidence, 0) AS INT) AS score FROM ef) "
       f"SELECT event_id, score, confidence, {_sev} AS severity, CASE WHEN score > 0 THEN {S.case_map(_sev, fv.ORCHESTRATED_TIER)} ELSE 'R1' END AS tier, "
       f"CASE WHEN coalesce(s_time, s_volume, s_domain, s_peer) IS NULL THEN '{fv.NO_SIGNAL_TEXT}' ELSE {S.case_map(_sev, fv.ORCHESTRATED_ACTION)} || ' ' || "
       f"CASE {_expl} END || CASE WHEN confidence < 0.9 THEN ' (baseline confidence ' || CAST(CAST(round_even(confidence * 100, 0) AS INT) AS VARCHAR) || "
       "'% -- limited history, treat with extra caution)' ELSE '' END END AS recommendation FROM sc2")
def m11(spark, sf):
    users, peers, known = baselines(spark, sf)
    return detect.detect_engine(security_events(spark, sf), users, peers, known, _KEY).select(
        "event_id", "score", "confidence", "severity", "tier", "recommendation")


def policy_rows(spark, sf):
    """Events with catalogue app, whether the user used the app before, and a scan outcome."""
    e = security_events(spark, sf).join(flat_events(spark, sf).select("event_id", "k"), "event_id")
    rows = catalogue.with_app(e, app_catalogue(spark))
    h = history(spark, sf)
    apps = catalogue.apps_of_domains(h, app_catalogue(spark))
    used = robust.known_apps(h, apps).select("user_id", F.col("app_name").alias("_a"), F.lit(True).alias("app_known"))
    rows = rows.withColumn("_a", F.col("app.name")).join(used, ["user_id", "_a"], "left")
    return (rows.withColumn("event_type", F.when(F.col("k") % 6 == 0, "dlp_outcome").otherwise(F.col("event_type")))
            .withColumn("detectors", F.expr("CASE WHEN k % 12 = 0 THEN array('ssn') ELSE array('api_key', 'jwt') END"))
            .withColumn("match_count", F.col("k") % 5)
            .withColumn("classification", F.expr("CASE WHEN k % 12 = 0 THEN 'highly_confidential' ELSE 'confidential' END")))


_KNOWN_APP = ("ka AS (SELECT DISTINCT hs.user_id, cat.name FROM hs JOIN da ON hs.domain = da.domain JOIN cat ON da.ord = cat.ord), "
              "pr AS (SELECT se.*, ev.k, cat.name, cat.category, cat.approval_state, cat.risk_weight, ka.user_id IS NOT NULL AS used FROM se JOIN ev USING (event_id) "
              "LEFT JOIN da ON se.domain = da.domain LEFT JOIN cat ON da.ord = cat.ord LEFT JOIN ka ON se.user_id = ka.user_id AND cat.name = ka.name)")
POLICY = S.ctes(S.EV, SE, HIST, CAT, APP, _KNOWN_APP)


@query("m8_catalogue_policy", POLICY + "SELECT event_id, " + _signals(
    ("unknown_application", "CASE WHEN domain IS NOT NULL AND name IS NULL THEN 0 END"),
    ("unapproved_app", "CASE WHEN approval_state = 'unapproved' THEN risk_weight END"),
    ("ai_tool_first_use", "CASE WHEN category = 'ai' AND NOT used THEN 15 END")) + " AS signals FROM pr")
def m8(spark, sf):
    return detect.with_signals(policy_rows(spark, sf), detect.policy_signals()).select(
        "event_id", signal_text().alias("signals"))


@query("m9_sensitive_upload", S.ctes(S.EV) + "SELECT event_id, CASE WHEN k % 12 = 0 THEN 50 ELSE 30 END AS score, "
       "CASE WHEN k % 12 = 0 THEN 'medium' ELSE 'low' END AS severity FROM ev WHERE k % 6 = 0 AND k % 5 > 0")
def m9(spark, sf):
    rows = policy_rows(spark, sf).withColumn("s", detect.sensitive_signal())
    return rows.where(F.col("s").isNotNull()).select("event_id", "s.score", "s.severity")
