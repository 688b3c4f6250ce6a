"""Scans and sinks, on files that Spark writes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verification import sql as S
from verification.alert_queries import ALERTS, employees, event_alerts, tiered
from verification.behaviour_queries import ROBUST, baselines
from verification.binding import canonical_events, flat_events, table, unified_events
from verification.core_queries import day, matrix, r6
from verification.registry import query
from verification.scalar_queries import MESSY, messy_events
from wardlight import fixed_values as fv
from wardlight.operators import alerts as AL
from wardlight.operators import features as FE
from wardlight.operators import quality
from wardlight.session import scratch_path
from wardlight.sources import canonical, casb, cert_logs, dimensions, siem, sinks

EV = S.ctes(S.EV)
_DATE = "date_format(ts, 'M/d/yyyy H:mm:ss')"
_RAW_LOGS = {
    "logon": ("login_event", ["'Logon' AS activity"]),
    "device": ("usb_connect", ["'Connect' AS activity"]),
    "file": ("file_access", ["CASE WHEN k % 3 = 0 THEN concat('R', k, '.tar.gz') WHEN k % 3 = 1 THEN 'README' ELSE '' END AS filename",
                             "'File Open' AS activity", "CASE WHEN k % 4 = 0 THEN 'True' ELSE 'False' END AS to_removable_media",
                             "CASE WHEN k % 4 = 1 THEN '1' ELSE '' END AS from_removable_media", "repeat('x', k) AS content"]),
    "http": ("browser_activity", ["concat('http://', coalesce(domain, 'plain.test'), '/p') AS url",
                                  "CASE k % 3 WHEN 0 THEN 'WWW Upload' WHEN 1 THEN 'WWW Download' ELSE 'WWW Visit' END AS activity",
                                  "CAST(CASE WHEN k % 5 = 0 THEN 'n/a' ELSE concat(bytes_sent, '.7') END AS STRING) AS size"]),
    "email": ("cloud_upload", ["CASE WHEN k % 9 = 0 THEN 'a@dtaa.com; B@Mail.test' WHEN k % 9 = 1 THEN '' ELSE ' A@DTAA.com ;' END AS `to`",
                               "'x' AS cc", "'' AS bcc", "'me@dtaa.com' AS `from`", "'Send' AS activity", "CAST(bytes_sent AS STRING) AS size",
                               "'0' AS attachments"]),
}


def raw_log(spark, sf, kind, drop=()):
    """Log rows in the CSV column layout; every tenth row of a date is unreadable."""
    event_type, columns = _RAW_LOGS[kind]
    e = flat_events(spark, sf).where(F.col("event_type") == event_type)
    date = f"CASE WHEN k % 10 = 9 THEN 'no date' ELSE {_DATE} END AS date"
    rows = e.selectExpr("CAST(eid AS STRING) AS id", date, "username AS user", "agent_id AS pc", *columns)
    return rows.drop(*drop)


def insider_rows(spark, sf):
    return (flat_events(spark, sf).where("uid % 5 = 0").select("username").distinct()
            .selectExpr("username AS user", "'1/1/2024 0:00:00' AS start", "'1/3/2024 23:59:59' AS end", "'s1' AS scenario"))


def windows(spark, sf):
    return cert_logs.window_rows(insider_rows(spark, sf), "insiders").withColumn("ord", F.lit(0))


_COLS = ("event_id", "event_type", "username", "hostname", "bytes_sent", "destination_domain", "file_name",
         "file_extension", "file_size_kb", "is_anomaly")


def converted(df):
    return df.select(*_COLS, F.unix_seconds("timestamp").alias("ts_seconds"), F.array_join("risk_reasons", "|").alias("reasons"),
                     F.coalesce("raw_data.external_recipient", F.lit(False)).alias("external"))


_WIN = "(uid % 5 = 0 AND ts < TIMESTAMP '2024-01-04')"
_IN = f"date_trunc('second', ts) <= TIMESTAMP '2024-01-03 23:59:59' AND uid % 5 = 0"


def _log_sql(kind):
    event_type = _RAW_LOGS[kind][0]
    et, b, dom, fn, ext, kb, more, external = ("NULL",) * 8
    external, more = "false", "NULL"
    if kind == "logon":
        et = "'login_event'"
    if kind == "device":
        et = "'usb_connect'"
    if kind == "file":
        et = "CASE WHEN k % 4 IN (0, 1) THEN 'file_transfer' ELSE 'file_access' END"
        fn = "CASE WHEN k % 3 = 0 THEN 'R' || CAST(k AS VARCHAR) || '.tar.gz' WHEN k % 3 = 1 THEN 'README' END"
        ext = "CASE WHEN k % 3 = 0 THEN '.gz' END"
        kb = "CASE WHEN k > 0 THEN round_even(k / 1024.0, 3) END"
    if kind == "http":
        et = "CASE k % 3 WHEN 0 THEN 'cloud_upload' WHEN 1 THEN 'file_transfer' ELSE 'browser_activity' END"
        b = "CASE WHEN k % 5 = 0 THEN 0 ELSE bytes_sent END"
        dom = "coalesce(domain, 'plain.test')"
    if kind == "email":
        et, b, external = "'network_connection'", "bytes_sent", "k % 9 = 0"
        more = "CASE WHEN k % 9 = 0 THEN 'external_recipient' END"
    return (f"SELECT 'CERT-{kind}-' || CAST(eid AS VARCHAR) AS event_id, {et} AS event_type, username, agent_id AS hostname, "
            f"CAST({b} AS BIGINT) AS bytes_sent, CAST({dom} AS VARCHAR) AS destination_domain, CAST({fn} AS VARCHAR) AS file_name, "
            f"CAST({ext} AS VARCHAR) AS file_extension, CAST({kb} AS DOUBLE) AS file_size_kb, {_IN} AS is_anomaly, "
            f"CAST(floor(epoch(ts)) AS BIGINT) AS ts_seconds, concat_ws('|', CASE WHEN {_IN} THEN 'cert_insider_scenario:s1' END, {more}) AS reasons, "
            f"{external} AS external FROM ev WHERE event_type = '{event_type}' AND k % 10 <> 9")


def _log_query(name, kind):
    @query(name, EV + _log_sql(kind))
    def run(spark, sf):
        return converted(cert_logs.convert(kind, raw_log(spark, sf, kind), windows(spark, sf)))
    return run


s3, s4, s5 = _log_query("s3_logon_rows", "logon"), _log_query("s4_device_rows", "device"), _log_query("s5_file_rows", "file")
s6, s7 = _log_query("s6_http_rows", "http"), _log_query("s7_email_rows", "email")


@query("s2_missing_columns", EV + "SELECT 'CERT-http-' || CAST(eid AS VARCHAR) AS event_id, CASE WHEN k % 10 IN (0, 2, 4) THEN 'cloud_upload' ELSE 'browser_activity' END "
       "AS event_type, 0 AS bytes_sent, concat_ws('|', CASE WHEN " + _IN + " THEN 'cert_insider_scenario:s1' END, CASE k % 10 WHEN 0 THEN 'heuristic_activity:upload:domain_hint:dropbox' "
       "WHEN 2 THEN 'heuristic_activity:upload:domain_hint:drive.google' WHEN 4 THEN 'heuristic_activity:upload:domain_hint:wetransfer' END) AS reasons "
       "FROM ev WHERE event_type = 'browser_activity' AND k % 10 <> 9")
def s2(spark, sf):
    raw = raw_log(spark, sf, "http", drop=("activity", "size"))
    return cert_logs.convert("http", raw, windows(spark, sf)).select(
        "event_id", "event_type", "bytes_sent", F.array_join("risk_reasons", "|").alias("reasons"))


@query("s8_common_columns", EV + f"SELECT 'CERT-logon-' || CAST(eid AS VARCHAR) AS event_id, 'agent-' || agent_id AS agent_id, 'cert_insider_threat' AS client_id, "
       f"CAST(CASE WHEN {_IN} THEN 90 ELSE 5 END AS DOUBLE) AS risk_score, CASE WHEN {_IN} THEN 'critical' ELSE 'low' END AS risk_category, "
       f"CASE WHEN {_IN} THEN 'T1052' ELSE '' END AS tags FROM ev WHERE event_type = 'login_event' AND k % 10 <> 9")
def s8(spark, sf):
    return cert_logs.convert("logon", raw_log(spark, sf, "logon"), windows(spark, sf)).select(
        "event_id", "agent_id", "client_id", "risk_score", "risk_category", F.array_join("mitre_tags", ",").alias("tags"))


def write_logs(spark, sf):
    root = scratch_path(spark, "logs")
    for kind in cert_logs.KINDS:
        raw_log(spark, sf, kind).write.option("header", True).option("escape", '"').csv(f"{root}/data/{kind}.csv")
    insider_rows(spark, sf).write.option("header", True).csv(f"{root}/answers/insiders.csv")
    return root


@query("s1_log_scan", EV + " UNION ALL ".join(_log_sql(k) for k in cert_logs.KINDS))
def s1(spark, sf):
    root = write_logs(spark, sf)
    return converted(cert_logs.cert_events(spark, f"{root}/data", f"{root}/answers", row_cap=None))


@query("s1_failed_rows", EV + " UNION ALL ".join(
    f"SELECT '{kind}.csv' AS file, 'unreadable date' AS error, CAST(eid AS VARCHAR) AS id FROM ev WHERE event_type = '{_RAW_LOGS[kind][0]}' AND k % 10 = 9"
    for kind in cert_logs.KINDS))
def s1_failed(spark, sf):
    root = write_logs(spark, sf)
    failed = cert_logs.scan_logs(spark, f"{root}/data", f"{root}/answers").failures()
    return failed.select("file", "error", F.get_json_object("record", "$.id").alias("id"))


@query("a21_file_counts", EV + " UNION ALL ".join(
    f"SELECT '{kind}.csv' AS file, count(*) AS read, count(*) FILTER (WHERE k % 10 <> 9) AS converted, count(*) FILTER (WHERE k % 10 = 9) AS failed "
    f"FROM ev WHERE event_type = '{_RAW_LOGS[kind][0]}'" for kind in cert_logs.KINDS if kind != "email") + " UNION ALL SELECT 'email.csv', 0, 0, 0")
def a21_files(spark, sf):
    """One log is missing."""
    root = scratch_path(spark, "some-logs")
    for kind in cert_logs.KINDS:
        if kind != "email":
            raw_log(spark, sf, kind).write.option("header", True).option("escape", '"').csv(f"{root}/{kind}.csv")
    return cert_logs.scan_logs(spark, root).counts().select("file", "read", "converted", "failed")


@query("l4_row_cap", EV + "SELECT 'CERT-logon-' || CAST(eid AS VARCHAR) AS event_id FROM (SELECT * FROM ev WHERE event_type = 'login_event' ORDER BY eid LIMIT 250) WHERE k % 10 <> 9")
def l4(spark, sf):
    """The first rows of a log of several files, in the order of the files."""
    root = scratch_path(spark, "cap")
    ids = raw_log(spark, sf, "logon").withColumn("_n", F.col("id").cast("bigint"))
    ids.repartitionByRange(5, "_n").sortWithinPartitions("_n").drop("_n").write.option("header", True).csv(f"{root}/logon.csv")
    return cert_logs.cert_events(spark, root, row_cap=250).select("event_id")


@query("a21_load_statistics", EV + f"SELECT event_type, count(*) AS total, count(*) FILTER (WHERE is_anomaly) AS anomalous FROM ("
       + " UNION ALL ".join(_log_sql(k) for k in cert_logs.KINDS) + ") GROUP BY event_type")
def a21(spark, sf):
    w = windows(spark, sf)
    parts = [cert_logs.convert(k, raw_log(spark, sf, k), w) for k in cert_logs.KINDS]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return cert_logs.load_statistics(union)


@query("j1_malicious_window", EV + ", w AS (SELECT username, 0 AS ord, TIMESTAMP '2024-01-01' AS s, TIMESTAMP '2024-01-03 23:59:59' AS e, 'a' AS scenario FROM ev WHERE uid % 5 = 0 GROUP BY 1 "
       "UNION ALL SELECT username, 1, min(ts), max(ts), 'b' FROM ev WHERE uid % 10 = 0 GROUP BY 1) SELECT event_id, (SELECT min_by(scenario, ord) FROM w WHERE w.username = ev.username "
       "AND ev.ts BETWEEN w.s AND w.e) AS scenario FROM ev")
def j1(spark, sf):
    e = flat_events(spark, sf)
    first = e.where("uid % 5 = 0").select("username").distinct().selectExpr(
        "username AS user", "0 AS ord", "timestamp'2024-01-01 00:00:00' AS start_ts", "timestamp'2024-01-03 23:59:59' AS end_ts", "'a' AS scenario")
    second = e.where("uid % 10 = 0").groupBy("username").agg(F.min("ts").alias("s"), F.max("ts").alias("e")).selectExpr(
        "username AS user", "1 AS ord", "s AS start_ts", "e AS end_ts", "'b' AS scenario")
    rows = e.select("event_id", F.col("username").alias("user"), "ts")
    return cert_logs.label_windows(rows, first.unionByName(second)).select("event_id", "scenario")


@query("s9_ground_truth", EV + "SELECT username AS \"user\", '2024-01-01 00:00:00' AS start_ts, '2024-01-03 23:59:59' AS end_ts, 's1' AS scenario FROM ev WHERE uid % 5 = 0 GROUP BY 1 "
       "UNION ALL SELECT username, '2024-01-05 06:00:00', '2024-01-05 06:00:00', 'single' FROM ev WHERE uid % 7 = 1 GROUP BY 1 "
       "UNION ALL SELECT username, '0001-01-01 00:00:00', '9999-12-31 23:59:59', 'whole' FROM ev WHERE uid % 11 = 2 GROUP BY 1")
def s9(spark, sf):
    root = scratch_path(spark, "answers")
    users = flat_events(spark, sf).select("username", "uid").distinct()
    insider_rows(spark, sf).write.option("header", True).csv(f"{root}/insiders.csv")
    dated = users.where("uid % 7 = 1").selectExpr("username AS insider", "'1/5/2024 6:00:00' AS date")
    wrong = users.where("uid % 7 = 2").selectExpr("username AS insider", "'5 Jan' AS date")
    dated.unionByName(wrong).write.option("header", True).csv(f"{root}/single.csv")
    users.where("uid % 11 = 2").selectExpr("username AS user_id", "uid AS other").write.option("header", True).csv(f"{root}/whole.csv")
    users.selectExpr("uid AS other").write.option("header", True).csv(f"{root}/unrelated.csv")
    w = cert_logs.malicious_windows(spark, root)
    return w.select("user", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"),
                    F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss").alias("end_ts"), "scenario")


@query("s10_psychometric", "SELECT c_name AS user_id, CAST(c_custkey % 50 AS VARCHAR) AS \"O\", CAST(c_custkey % 40 AS VARCHAR) AS \"C\", CAST(c_nationkey AS VARCHAR) AS \"N\" FROM customer")
def s10(spark, sf):
    root = scratch_path(spark, "traits")
    table(spark, sf, "customer").selectExpr("c_name AS user_id", "c_custkey % 50 AS O", "c_custkey % 40 AS C", "c_nationkey AS N").write.option(
        "header", True).csv(f"{root}/Psychometric.csv")
    return cert_logs.psychometric(spark, root)


_ACT = "CASE k % 6 WHEN 0 THEN 'file_view' WHEN 1 THEN 'usb_transfer' WHEN 2 THEN 'email_send' WHEN 3 THEN 'saas_signup' WHEN 4 THEN 'external_share_link_created' ELSE 'mystery' END"
_ACT_ET = "CASE k % 6 WHEN 0 THEN 'file_access' WHEN 1 THEN 'usb_connect' WHEN 2 THEN 'network_connection' WHEN 3 THEN 'app_install' WHEN 4 THEN 'cloud_upload' ELSE 'app_launch' END"


def casb_rows(spark, sf):
    return flat_events(spark, sf).selectExpr(
        "event_id", "date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS timestamp", "username AS user_id", "CASE WHEN k % 2 = 0 THEN agent_id END AS device_id",
        f"{_ACT} AS activity_type", "domain AS destination_domain", "CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE k / 4 END AS STRING) AS data_volume_mb",
        "coalesce(app_name, 'None') AS app_name", "'Storage' AS app_category", "CASE WHEN k % 2 = 0 THEN 'High' ELSE 'Odd' END AS risk_tier",
        "CAST(k AS STRING) AS risk_score", "CAST(label AS STRING) AS is_incident", "CAST(k % 2 AS STRING) AS device_managed")


@query("s11_casb_scan", EV + f"SELECT event_id, {_ACT_ET} AS event_type, CASE WHEN k % 2 = 0 THEN agent_id ELSE username || '-device' END AS hostname, "
       "CASE WHEN k % 6 = 2 THEN domain END AS destination_domain, CASE WHEN k % 6 = 2 AND k % 5 > 0 THEN CAST(k / 4.0 * 1048576 AS BIGINT) END AS bytes_sent, "
       "CASE WHEN k % 6 IN (0, 4) AND k % 5 > 0 THEN round_even(k / 4.0 * 1024, 2) END AS file_size_kb, "
       "CASE WHEN k % 6 IN (0, 4) AND app_name IS NOT NULL THEN CASE k % 6 WHEN 0 THEN 'file_view_' ELSE 'external_share_link_created_' END || event_id END AS file_name, "
       "CASE WHEN k % 6 IN (3, 5) THEN app_name END AS app_name, CASE WHEN k % 2 = 0 THEN 'high' END AS risk_category, label = 1 AS is_anomaly, "
       "CASE WHEN k % 2 = 0 THEN 'unmanaged_device' ELSE '' END AS reasons FROM ev")
def s11(spark, sf):
    root = scratch_path(spark, "casb")
    casb_rows(spark, sf).write.options(header=True, escape="\"", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(root)
    return casb.casb_events(spark, root).select(
        "event_id", "event_type", "hostname", "destination_domain", "bytes_sent", "file_size_kb", "file_name", "app_name", "risk_category",
        "is_anomaly", F.array_join("risk_reasons", "|").alias("reasons"))


@query("s12_employees", "SELECT 'user-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS user_id, c_mktsegment AS department, "
       "CASE WHEN c_custkey % 7 = 0 THEN 'None' ELSE 'analyst' END AS role FROM customer")
def s12(spark, sf):
    root = scratch_path(spark, "employees")
    employees(spark, sf).write.option("header", True).csv(root)
    return casb.employees(spark, root)


_RULES = [r[0] for r in fv.SIEM_RULES]
_RULE = "CASE WHEN k % 14 < 12 THEN element_at(array(" + ", ".join(f"'{r}'" for r in _RULES) + "), k % 14 + 1) ELSE concat('9', k) END"


def siem_alerts(spark, sf):
    return flat_events(spark, sf).selectExpr(
        "CASE WHEN k % 5 > 0 THEN event_id END AS id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS timestamp",
        f"named_struct('id', {_RULE}, 'level', k % 15, 'description', 'd', 'groups', array('dns'), 'mitre', named_struct('id', CASE WHEN k % 2 = 0 THEN array('T1052') END)) AS rule",
        "named_struct('id', agent_id, 'name', concat('WIN10-OPS-', lpad(k, 2, '0'))) AS agent",
        "named_struct('win', named_struct('eventdata', named_struct('user', concat('HOST', char(92), username), 'queryName', domain, 'image', 'x')), "
        "'dstuser', CASE WHEN k % 3 = 0 THEN username ELSE '' END, 'srcuser', CASE WHEN k % 3 = 1 THEN concat('s-', username) END) AS data",
        "CASE WHEN k % 7 = 0 THEN 'Package removed' END AS full_log", "event_id AS _eid", "k AS _k")


_RT = "rt AS (SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in (i, *r)) + ")" for i, r in enumerate(fv.SIEM_RULES)) + ") t(i, rule_id, et, cat, sig))"
_TAG = f"coalesce({S.case_map('cat', fv.CATEGORY_TECHNIQUE)}, {S.case_map('sig', fv.SIGNAL_TECHNIQUE)}, 'T1052')"


@query("s13_siem_alerts", S.ctes(S.EV, _RT) + "SELECT CASE WHEN k % 5 > 0 THEN event_id ELSE 'wazuh-' || rule_id || '-' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS event_id, "
       f"et AS event_type, username, cat AS shadow_it_category, 'Ops' AS department, {_TAG} AS mitre_tag, "
       f"CASE WHEN k % 2 = 0 AND {_TAG} <> 'T1052' THEN 'wazuh_reported=T1052, pipeline_assigned=' || {_TAG} END AS mitre_note, domain AS destination_domain "
       "FROM ev JOIN rt ON ev.k % 14 = CAST(rt.i AS INT)")
def s13(spark, sf):
    root = scratch_path(spark, "alerts")
    siem_alerts(spark, sf).drop("_eid", "_k").write.json(root)
    return siem.siem_events(siem.read_alerts(spark, root), "acme").select(
        "event_id", "event_type", "username", "shadow_it_category", "department", "mitre_tag", "mitre_note", "destination_domain")


@query("j17_rule_lookup", S.ctes(S.EV, _RT) + "SELECT rule_id, et AS event_type, cat AS shadow_it_category, sig AS cert_signal, count(*) AS n FROM ev JOIN rt ON ev.k % 14 = CAST(rt.i AS INT) GROUP BY ALL")
def j17(spark, sf):
    rules = dimensions.siem_rules(spark)
    alerts = siem_alerts(spark, sf).select(F.col("rule.id").alias("rule_id"))
    return alerts.join(F.broadcast(rules), "rule_id").groupBy(
        "rule_id", F.col("rule_event_type").alias("event_type"), "shadow_it_category", "cert_signal").agg(F.count(F.lit(1)).alias("n"))


@query("s13_unknown_rules", EV + "SELECT '9' || CAST(k AS VARCHAR) AS rule_id, count(*) AS n FROM ev WHERE k % 14 >= 12 GROUP BY 1")
def s13u(spark, sf):
    return siem.unknown_rules(siem_alerts(spark, sf))


_GROUPS = ("CASE k % 6 WHEN 0 THEN array('syscheck', 'file') WHEN 1 THEN array('usb') WHEN 2 THEN array('software') WHEN 3 THEN array('dlp') WHEN 4 THEN array('web') END")
_KIND = ("CASE WHEN k % 6 = 0 THEN 'file_integrity' WHEN k % 6 = 1 THEN 'file_upload' WHEN k % 6 = 2 OR k % 7 = 0 THEN 'installed_application' "
         "WHEN k % 6 = 3 THEN 'dlp_outcome' ELSE 'network_access' END")


def siem_hits(spark, sf):
    a = siem_alerts(spark, sf)
    groups = F.expr(_GROUPS.replace("k %", "_k %"))
    source = F.struct("id", "timestamp", F.col("rule").withField("groups", groups).alias("rule"), "agent", "data", "full_log")
    return a.select(F.col("_eid").alias("_id"), source.alias("_source"), F.col("_k").alias("k"))


@query("s14_index_hits", EV + "SELECT event_id, 'user-' || CASE WHEN k % 3 = 0 THEN username WHEN k % 3 = 1 THEN 's-' || username ELSE 'WIN10-OPS-' || lpad(CAST(k AS VARCHAR), 2, '0') END AS user_id, "
       f"'agent-' || agent_id AS device_id, {_KIND} AS event_type, CAST(k % 15 AS VARCHAR) AS rule_level, domain AS query_name FROM ev")
def s14(spark, sf):
    root = scratch_path(spark, "hits")
    siem_hits(spark, sf).select("_id", "_source").write.json(root)
    return siem.hit_events(siem.read_hits(spark, root), "tenant-a").select(
        "event_id", "user_id", "device_id", "event_type", F.get_json_object("metadata", "$.rule_level").alias("rule_level"),
        F.get_json_object("metadata", "$.win_eventdata.queryName").alias("query_name"))


@query("s15_rule_groups", EV + f"SELECT event_id, {_KIND} AS event_type FROM ev")
def s15(spark, sf):
    from wardlight.functions.rules import siem_event_kind

    return siem_hits(spark, sf).select(F.col("_id").alias("event_id"), siem_event_kind(
        "_source.rule.groups", "_source.full_log").alias("event_type"))


def collector(spark, sf):
    return flat_events(spark, sf).selectExpr(
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") AS timestamp", "CASE k % 4 WHEN 0 THEN 'browser' WHEN 1 THEN 'installed_app' WHEN 2 THEN 'upload' ELSE 'dlp' END AS kind",
        "username AS user", "concat('dev-', agent_id) AS device", "domain", "CASE WHEN k % 8 = 0 THEN k END AS duration_seconds", "'pub' AS publisher", "app_name AS product",
        "CASE WHEN k % 8 = 1 THEN '2' END AS version", "bytes_sent AS bytes_transferred", "'confidential' AS classification", "array('jwt') AS detectors", "k AS match_count")


@query("s16_collector_records", EV + "SELECT username AS user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS occurred_at, CASE k % 4 WHEN 0 THEN 'network_access' WHEN 1 THEN 'installed_application' "
       "WHEN 2 THEN 'file_upload' ELSE 'dlp_outcome' END AS event_type, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN k ELSE 0 END END AS duration, "
       "CASE WHEN k % 4 = 1 THEN CASE WHEN k % 8 = 1 THEN '2' ELSE 'unknown' END END AS version, CASE WHEN k % 4 = 2 THEN bytes_sent END AS moved, "
       "CASE WHEN k % 4 = 3 THEN k END AS match_count, 44 AS id_length FROM ev")
def s16(spark, sf):
    root = scratch_path(spark, "collector")
    collector(spark, sf).write.json(root)

    def meta(path):
        return F.get_json_object("metadata", path)

    return canonical.read_collector(spark, root, "demo-acme").select(
        "user_id", "occurred_at", "event_type", meta("$.duration_seconds").cast("int").alias("duration"), meta("$.version").alias("version"),
        meta("$.bytes_transferred").cast("bigint").alias("moved"), meta("$.match_count").cast("int").alias("match_count"), F.length("event_id").alias("id_length"))


def canonical_lines(spark, sf):
    c = canonical_events(spark, sf).join(flat_events(spark, sf).select("event_id", "k"), "event_id")
    stamp = F.concat(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("k") % 13 == 0, "+02:00").otherwise("Z"))
    return c.select("schema_version", F.when(F.col("k") % 11 == 0, "Bad Tenant").otherwise(F.col("tenant_id")).alias("tenant_id"), "event_id",
                    stamp.alias("occurred_at"), "user_id", "device_id", "source", "event_type", "metadata")


@query("s17_canonical_lines", EV + "SELECT event_id, CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN 'quarantine' ELSE 'accepted' END AS outcome, "
       "CASE WHEN k % 11 = 0 AND k % 13 = 0 THEN 'tenant_id: pattern; occurred_at: utc' WHEN k % 11 = 0 THEN 'tenant_id: pattern' WHEN k % 13 = 0 THEN 'occurred_at: utc' END AS error FROM ev")
def s17(spark, sf):
    root = scratch_path(spark, "canonical")
    canonical_lines(spark, sf).write.json(root)
    good, bad = canonical.read_canonical(spark, root)
    return (good.select("event_id", F.lit("accepted").alias("outcome"), F.lit(None).cast("string").alias("error"))
            .unionByName(bad.select("event_id", F.lit("quarantine").alias("outcome"), "error")))


@query("s18_catalogue", "SELECT CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INT) AS ord, p_brand AS name, lower(replace(p_brand, '#', '')) || '.test' AS domain, "
       "CAST(count(*) % 30 AS INT) AS risk_weight FROM part GROUP BY p_brand")
def s18(spark, sf):
    root = scratch_path(spark, "catalogue")
    apps = table(spark, sf, "part").groupBy("p_brand").agg((F.count(F.lit(1)) % 30).cast("int").alias("risk_weight"))
    item = F.struct(F.col("p_brand").alias("name"), F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".test")).alias("domain"),
                    F.lit("x").alias("category"), F.lit("approved").alias("approval_state"), "risk_weight")
    # A catalogue is one small file: brands, not parts.
    apps.agg(F.to_json(F.sort_array(F.collect_list(item))).alias("value")).write.text(root)
    return dimensions.application_catalogue(spark, root).select("ord", "name", "domain", "risk_weight")


@query("s19_remediation", "SELECT '9.' || CAST(p_partkey AS VARCHAR) AS section_id, p_brand AS section_title, CAST(n - 1 AS INT) AS ord, CAST(n AS INT) AS fix_no, p_name || ' ' || CAST(n AS VARCHAR) AS fix_title, "
       "'Verified ' || p_type AS evidence_tier FROM part, unnest([1, 2, 3]) u(n) WHERE n <= p_partkey % 4 UNION ALL "
       "SELECT '9.' || CAST(p_partkey AS VARCHAR), p_brand, 0, NULL, NULL, NULL FROM part WHERE p_partkey % 4 = 0")
def s19(spark, sf):
    root = scratch_path(spark, "reports")
    fix = "concat('**Fix ', n, ' — ', p_name, ' ', n, '.** *(Verified ', p_type, ')*\\n\\nText.\\n')"
    doc = table(spark, sf, "part").selectExpr(
        "concat('## 9.', p_partkey, ' ', p_brand, ' — research\\n\\n', array_join(transform(filter(array(1, 2, 3), n -> n <= p_partkey % 4), n -> " + fix + "), '\\n')) AS value")
    doc.write.text(root)
    return dimensions.remediation(spark, root)


@query("s20_event_files", EV + "SELECT event_id, CASE WHEN k % 12 IN (1, 2) THEN 'quarantine' ELSE 'accepted' END AS outcome FROM ev WHERE k % 12 <> 3 UNION ALL "
       "SELECT NULL, 'quarantine' FROM ev WHERE k % 12 = 3")
def s20(spark, sf):
    root = scratch_path(spark, "events")
    e = unified_events(spark, sf).join(flat_events(spark, sf).select("event_id", F.col("k").alias("_k")), "event_id")
    e = (e.withColumn("event_type", F.when(F.col("_k") % 12 == 1, "odd_type").otherwise(F.col("event_type")))
         .withColumn("timestamp", F.when(F.col("_k") % 12 != 2, F.col("timestamp"))))
    line = F.to_json(F.struct(*[c for c in e.columns if c != "_k"]))
    e.select(F.when(F.col("_k") % 12 == 3, "{broken").otherwise(line).alias("value")).write.text(root)
    good, bad = canonical.read_unified(spark, root)
    return good.select("event_id", F.lit("accepted").alias("outcome")).unionByName(
        bad.select("event_id", F.lit("quarantine").alias("outcome")))


@query("s21_stored_matrix", S.MATRIX + "SELECT event_id, hour, is_off_hours FROM fm")
def s21(spark, sf):
    path = scratch_path(spark, "matrix")
    sinks.write_table(matrix(spark, sf), path)
    return sinks.read_table(spark, path, "event_id", "hour", "is_off_hours")


@query("k1_normalized_and_quarantine", MESSY + "SELECT event_id, CASE WHEN trim(username) = '' THEN 'quarantine' ELSE 'accepted' END AS outcome FROM norm")
def k1(spark, sf):
    root = scratch_path(spark, "normalized")
    rows = quality.normalize(quality.keep_first(messy_events(spark, sf)))
    sinks.write_normalized(rows, f"{root}/events", f"{root}/quarantine")
    return (spark.read.parquet(f"{root}/events").select("event_id", F.lit("accepted").alias("outcome"))
            .unionByName(spark.read.schema("event_id string, error string").json(f"{root}/quarantine").select(
                "event_id", F.lit("quarantine").alias("outcome"))))


@query("k2_daily_table", S.MATRIX + "SELECT _username, CAST(d AS VARCHAR) AS date, count(*) AS daily_event_count FROM fm GROUP BY ALL")
def k2(spark, sf):
    path = scratch_path(spark, "daily")
    sinks.write_table(FE.daily_features(matrix(spark, sf)), path, by="date")
    return sinks.read_table(spark, path, "_username", "date", "daily_event_count").withColumn("date", F.col("date").cast("string"))


@query("k3_alert_json", ALERTS + 'SELECT id, "userId", score, n_evidence FROM al')
def k3(spark, sf):
    path = scratch_path(spark, "alert-json")
    a = event_alerts(spark, sf)
    sinks.write_alert_json(a, path)
    return spark.read.schema(a.schema).json(path).select("id", "userId", "score", F.size("evidence").alias("n_evidence"))


@query("k4_alert_csv", ALERTS + """SELECT id, "userId", "userId" AS "userName", 'Unclassified' AS department, severity, CAST(score AS VARCHAR) AS score, app, category, status, tier FROM al""")
def k4(spark, sf):
    path = scratch_path(spark, "alert-csv")
    sinks.write_alert_csv(event_alerts(spark, sf), path)
    return spark.read.option("header", True).csv(path).drop("createdAt")


@query("k5_score_upsert", EV + "SELECT event_id, CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END AS score FROM ev")
def k5(spark, sf):
    path = scratch_path(spark, "scores")
    e = flat_events(spark, sf)
    sinks.append_scores(e.select("event_id", F.col("k").alias("score"), F.col("ts").alias("computed_at")), path)
    later = e.where("k % 2 = 0").select("event_id", (F.col("k") + 1).alias("score"), F.expr("ts + INTERVAL 1 DAY").alias("computed_at"))
    sinks.append_scores(later, path)
    return AL.latest_by(spark.read.parquet(path), ["event_id"], [F.desc("computed_at")]).select("event_id", "score")


@query("k6_baseline_versions", ROBUST + "SELECT user_id, CASE WHEN CAST(substr(user_id, 6) AS INT) % 2 = 0 THEN sample_days ELSE 0 END AS sample_days FROM ub2")
def k6(spark, sf):
    root = scratch_path(spark, "baselines")
    users = baselines(spark, sf)[0].select("user_id", "sample_days")
    first = sinks.write_baselines(users.withColumn("sample_days", F.lit(0).cast("bigint")), root, "1", "user_id")
    recent = users.where(F.substring("user_id", 6, 6).cast("int") % 2 == 0)
    return spark.read.parquet(sinks.write_baselines(recent, root, "2", "user_id", spark.read.parquet(first)))


@query("k9_report_table", S.ctes(S.EV) + "SELECT event_type, count(*) AS n FROM ev GROUP BY event_type")
def k9(spark, sf):
    path = scratch_path(spark, "report")
    sinks.write_table(flat_events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path)
    return sinks.read_table(spark, path)


@query("j15_backfill_targets", EV + "SELECT event_id FROM ev WHERE k % 3 <> 0")
def j15(spark, sf):
    from wardlight.plans.nightly import backfill_targets

    scored = flat_events(spark, sf).where("k % 3 = 0").select("event_id")
    return backfill_targets(canonical_events(spark, sf), scored).select("event_id")
