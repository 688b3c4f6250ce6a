"""Column functions over the event, page and document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verification import sql as S
from verification.binding import canonical_events, flat_events, table, unified_events
from verification.registry import query
from wardlight import fixed_values as fv
from wardlight.functions import contracts, rules, text
from wardlight.operators import quality
from wardlight.plans import adapt

EV = S.ctes(S.EV)


@query("p1_app_name", EV + r"SELECT event_id, coalesce(nullif(trim(regexp_replace(app_name, '\s*\([^)]*\)\s*$', '')), ''), "
       "app_name) AS app_name, app_name AS app_name_original FROM ev")
def p1(spark, sf):
    return flat_events(spark, sf).select("event_id", text.canonical_app_name("app_name").alias("app_name"),
                                         F.col("app_name").alias("app_name_original"))


@query("p2_domain", r"SELECT page_id, regexp_replace(split_part(regexp_replace(lower(trim(url)), '^https?://', ''), '/', 1), "
       r"'^www\.', '') AS domain FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '  ' || upper(url) WHEN 1 THEN "
       "replace(url, '://', '://www.') ELSE url END AS url FROM pages)")
def p2(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.expr(
        "CASE page_id % 3 WHEN 0 THEN '  ' || upper(url) WHEN 1 THEN replace(url, '://', '://www.') ELSE url END").alias("url"))
    return p.select("page_id", text.canonical_domain("url").alias("domain"))


@query("p3_utc", EV + "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN k % 3 = 2 THEN 7200 ELSE 0 END AS utc_seconds FROM ev")
def p3(spark, sf):
    e = flat_events(spark, sf)
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
                     F.expr("CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'Z' ELSE '+02:00' END"))
    return e.select("event_id", F.unix_seconds(text.utc_timestamp(stamp)).alias("utc_seconds"))


_MESSY_COLS = """event_id, eid, k, ts, client_id, event_type, bytes_sent, bytes_received, file_size_kb, app_name, label,
  CASE WHEN k % 50 = 3 THEN '   ' ELSE '  ' || username END AS username,
  CASE WHEN k % 3 = 0 THEN 'https://www.' || upper(domain) || '/x' ELSE domain END AS domain"""
_MESSY = f"""messy AS (SELECT {_MESSY_COLS}, eid * 2 AS input_ord FROM ev
UNION ALL SELECT {_MESSY_COLS}, eid * 2 + 1 AS input_ord FROM ev WHERE k % 7 = 0),
firsts AS (SELECT * FROM messy QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY input_ord) = 1),
norm AS (SELECT *, regexp_replace(split_part(regexp_replace(lower(trim(domain)), '^https?://', ''), '/', 1), '^www\\.', '') AS c_domain,
  coalesce(nullif(trim(regexp_replace(app_name, '\\s*\\([^)]*\\)\\s*$', '')), ''), app_name) AS c_app,
  event_type IN ({S.quoted(fv.NETWORK_EVENT_TYPES)}) AS net, event_type IN ({S.quoted(fv.FILE_EVENT_TYPES)}) AS fil FROM firsts)"""
MESSY = S.ctes(S.EV, _MESSY)


def messy_events(spark, sf):
    """Unified events with padded names, URL-shaped domains and later copies of some ids."""
    e = unified_events(spark, sf)
    f = flat_events(spark, sf).select("event_id", "eid", "k")
    e = e.join(f, "event_id")
    e = (e.withColumn("username", F.expr("CASE WHEN k % 50 = 3 THEN '   ' ELSE '  ' || username END"))
         .withColumn("destination_domain", F.expr(
             "CASE WHEN k % 3 = 0 THEN 'https://www.' || upper(destination_domain) || '/x' ELSE destination_domain END"))
         .withColumn("is_anomaly", F.when(F.col("k") % 5 > 0, F.col("is_anomaly"))))
    copies = e.where(F.col("k") % 7 == 0).withColumn("input_ord", F.col("eid") * 2 + 1)
    return e.withColumn("input_ord", F.col("eid") * 2).unionByName(copies).drop("eid", "k")


def normalized(spark, sf):
    return quality.normalize(quality.keep_first(messy_events(spark, sf)))


@query("p4_quarantine", MESSY + "SELECT event_id, 'missing identity field' AS error FROM norm WHERE trim(username) = ''")
def p4(spark, sf):
    return quality.quarantine_rows(normalized(spark, sf))


@query("p5_imputed_events", MESSY + "SELECT event_id, trim(username) AS username, c_domain AS domain, c_app AS app_name, "
       "CASE WHEN c_app <> app_name THEN app_name END AS app_name_original, CASE WHEN net THEN coalesce(bytes_sent, 0) ELSE bytes_sent END AS bytes_sent, "
       "CASE WHEN net THEN coalesce(bytes_received, 0) ELSE bytes_received END AS bytes_received, "
       "round(CASE WHEN fil THEN coalesce(file_size_kb, 0) ELSE file_size_kb END, 6) AS file_size_kb, "
       "k % 5 > 0 AND label = 1 AS is_anomaly FROM norm WHERE trim(username) <> ''")
def p5(spark, sf):
    return quality.good_rows(normalized(spark, sf)).select(
        "event_id", "username", F.col("destination_domain").alias("domain"), "app_name",
        F.col("raw_data.app_name_original").alias("app_name_original"), "bytes_sent", "bytes_received",
        F.round("file_size_kb", 6).alias("file_size_kb"), "is_anomaly")


@query("w4_keep_first", MESSY + "SELECT event_id, input_ord FROM firsts")
def w4(spark, sf):
    return quality.keep_first(messy_events(spark, sf)).select("event_id", "input_ord")


@query("w4_incremental", MESSY + "SELECT event_id, input_ord FROM firsts WHERE event_id NOT IN (SELECT event_id FROM ev WHERE k >= 50)")
def w4_inc(spark, sf):
    stored = flat_events(spark, sf).where(F.col("k") >= 50)
    return quality.keep_first(messy_events(spark, sf), existing=stored).select("event_id", "input_ord")


@query("a20_normalization_statistics", MESSY + """SELECT (SELECT count(*) FROM messy) AS total_in,
  count(*) FILTER (WHERE trim(username) <> '') AS normalized, count(*) FILTER (WHERE trim(username) = '') AS quarantined,
  (SELECT count(*) FROM messy) - count(*) AS duplicates_dropped,
  count(*) FILTER (WHERE trim(username) <> '' AND c_app <> app_name) AS app_names_canonicalized,
  count(*) FILTER (WHERE trim(username) <> '' AND c_domain <> domain) AS domains_canonicalized,
  CAST(sum(CASE WHEN trim(username) <> '' THEN CAST(net AND bytes_sent IS NULL AS INT) + CAST(net AND bytes_received IS NULL AS INT)
    + CAST(fil AND file_size_kb IS NULL AS INT) + 2 + CAST(k % 5 = 0 AS INT) ELSE 0 END) AS BIGINT) AS fields_imputed FROM norm""")
def a20(spark, sf):
    return quality.normalization_statistics(messy_events(spark, sf), normalized(spark, sf))


@query("k7_ingest_status", MESSY + "SELECT event_id, input_ord, CASE WHEN event_id IN (SELECT event_id FROM ev WHERE k >= 50) OR "
       "row_number() OVER (PARTITION BY event_id ORDER BY input_ord) > 1 THEN 'duplicate' ELSE 'accepted' END AS status FROM messy")
def k7(spark, sf):
    stored = flat_events(spark, sf).where(F.col("k") >= 50)
    return quality.ingest_status(messy_events(spark, sf), stored).select("event_id", "input_ord", "status")


@query("p6_url_authority", r"SELECT page_id, nullif(regexp_extract(CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END, "
       r"'^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '') AS authority FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url "
       "ELSE regexp_replace(url, '^https?://', '') END AS url FROM pages)")
def p6(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.expr(
        "CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?://', '') END").alias("url"))
    return p.select("page_id", text.url_authority("url").alias("authority"))


_URL = ("CASE page_id % 5 WHEN 0 THEN url || '/Dropbox/up' WHEN 1 THEN 'http://files.test/a.ZIP?x=1' WHEN 2 THEN "
        "url || '/report.docx' ELSE url END")
_hint = "CASE " + " ".join(f"WHEN contains(lower(u), '{h}') THEN '{h}'" for h in fv.UPLOAD_DOMAIN_HINTS) + " END"
_ext = "CASE " + " ".join(f"WHEN ends_with(split_part(lower(u), '?', 1), '{x}') THEN '{x}'" for x in fv.DOWNLOAD_EXTENSIONS) + " END"


@query("p7_url_activity", f"WITH p AS (SELECT page_id, {_URL} AS u FROM pages), h AS (SELECT page_id, {_hint} AS hint, {_ext} AS ext FROM p) "
       "SELECT page_id, CASE WHEN hint IS NOT NULL THEN 'cloud_upload' WHEN ext IS NOT NULL THEN 'file_transfer' ELSE 'browser_activity' END AS event_type, "
       "CASE WHEN hint IS NOT NULL THEN 'upload' WHEN ext IS NOT NULL THEN 'download' ELSE 'browse' END AS label, "
       "CASE WHEN hint IS NOT NULL THEN 'domain_hint:' || hint WHEN ext IS NOT NULL THEN 'url_extension:' || ext ELSE 'no_hint_matched' END AS reason FROM h")
def p7(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.expr(_URL).alias("u"))
    return p.select("page_id", text.url_activity("u").alias("a")).select("page_id", "a.*")


_TRUTH = "CASE k % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes ' WHEN 2 THEN '0' WHEN 3 THEN '1' END"


@query("p8_truthy", EV + "SELECT event_id, k % 5 IN (0, 1, 3) AS flag FROM ev")
def p8(spark, sf):
    return flat_events(spark, sf).select("event_id", text.truthy(F.expr(_TRUTH)).alias("flag"))


@query("p9_null_markers", EV + "SELECT event_id, CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN '0' ELSE domain END AS cleaned, "
       "CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS number FROM ev")
def p9(spark, sf):
    marker = F.expr("CASE k % 6 WHEN 0 THEN 'None' WHEN 1 THEN ' nan ' WHEN 2 THEN '' WHEN 3 THEN '0' ELSE domain END")
    number = F.expr("CASE WHEN k % 4 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(k AS DOUBLE) END")
    return flat_events(spark, sf).select("event_id", text.clean_marker(marker).alias("cleaned"),
                                         text.clean_number(number).alias("number"))


@query("p10_risk_reasons", EV + "SELECT event_id, array_to_string(list_filter([CASE WHEN hour(ts) < 7 OR hour(ts) >= 19 THEN 'off_hours_activity' END, "
       "CASE WHEN device_managed = 0 THEN 'unmanaged_device' END, 'shadow_it:' || shadow_it_category, "
       "CASE WHEN sanction_status = 'Unsanctioned' THEN 'unsanctioned_application' END, "
       "CASE WHEN auth_method IN ('personal_email_signup', 'shared_credential', 'none') THEN 'weak_auth_method' END, "
       "CASE WHEN k % 3 = 0 THEN 'sensitive_data:Restricted-PII' END, CASE WHEN k % 4 = 0 THEN 'broad_oauth_scope' END, "
       "CASE WHEN policy_violation = 1 THEN 'policy_violation' END], lambda x: x IS NOT NULL), '|') AS reasons FROM ev")
def p10(spark, sf):
    e = (flat_events(spark, sf)
         .withColumn("is_off_hours", F.expr("CASE WHEN hour(ts) < 7 OR hour(ts) >= 19 THEN 1 ELSE 0 END"))
         .withColumn("data_classification", F.expr("CASE WHEN k % 3 = 0 THEN 'Restricted-PII' ELSE 'None' END"))
         .withColumn("oauth_scope_granted", F.expr("CASE k % 4 WHEN 0 THEN 'drive.full_access' WHEN 1 THEN 'read' END")))
    return e.select("event_id", F.array_join(rules.casb_risk_reasons(F.col), "|").alias("reasons"))


@query("p11_windows_user", EV + "SELECT event_id, CASE WHEN k % 3 = 2 THEN 'unknown' ELSE username END AS username FROM ev")
def p11(spark, sf):
    raw = F.expr(r"CASE k % 3 WHEN 0 THEN concat('HOST', char(92), username) WHEN 1 THEN username ELSE '' END")
    return flat_events(spark, sf).select("event_id", text.windows_user(raw).alias("username"))


@query("p12_host_department", EV + "SELECT event_id, CASE WHEN k % 4 = 3 THEN 'Unclassified' ELSE upper(substr(dep, 1, 1)) || lower(substr(dep, 2)) END AS department "
       "FROM (SELECT event_id, k, replace(department, ' ', '') AS dep FROM ev)")
def p12(spark, sf):
    host = F.expr("CASE WHEN k % 4 = 3 THEN 'laptop' ELSE concat('WIN10-', upper(replace(department, ' ', '')), '-', lpad(CAST(k AS STRING), 2, '0')) END")
    return flat_events(spark, sf).select("event_id", text.department_of_host(host).alias("department"))


_SIGNAL = ("CASE WHEN to_removable_media OR from_removable_media THEN 'is_removable_media' WHEN coalesce(external_recipient, false) "
           "THEN 'external_recipient' END")


@query("p13_technique_tag", EV + f"SELECT event_id, coalesce({S.case_map('shadow_it_category', fv.CATEGORY_TECHNIQUE)}, "
       f"{S.case_map('sig', fv.SIGNAL_TECHNIQUE)}, 'T1052') AS tag FROM (SELECT event_id, shadow_it_category, {_SIGNAL} AS sig FROM ev)")
def p13(spark, sf):
    return flat_events(spark, sf).select("event_id", rules.technique_tag("shadow_it_category", F.expr(_SIGNAL)).alias("tag"))


@query("p14_technique_note", EV + "SELECT event_id, CASE WHEN k % 3 = 0 AND tag <> 'T1052' THEN 'wazuh_reported=T1052, pipeline_assigned=' || tag END AS note "
       f"FROM (SELECT event_id, k, coalesce({S.case_map('shadow_it_category', fv.CATEGORY_TECHNIQUE)}, 'T1052') AS tag FROM ev)")
def p14(spark, sf):
    e = flat_events(spark, sf).withColumn("tag", rules.technique_tag("shadow_it_category", F.lit(None).cast("string")))
    reported = F.when(F.col("k") % 3 == 0, "T1052")
    return e.select("event_id", rules.technique_note(reported, F.col("tag")).alias("note"))


_KEY = "check-key"


def _pad(byte: int) -> str:
    return "".join(f"\\x{b ^ byte:02X}" for b in _KEY.encode().ljust(64, b"\0"))


@query("p16_domain_token", EV + "SELECT domain, count(*) AS n, "
       f"sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(domain)))) AS token "
       "FROM ev WHERE domain IS NOT NULL GROUP BY domain")
def p16(spark, sf):
    e = flat_events(spark, sf).where(F.col("domain").isNotNull())
    shaped = F.concat(F.lit(" "), F.upper("domain"), F.lit(". "))
    return (e.groupBy("domain", text.domain_token(shaped, _KEY).alias("token"))
            .agg(F.count(F.lit(1)).alias("n")).select("domain", "n", "token"))


_detectors = {
    "api_key": r"(?i)\bapi[_-]?key\s*[:=]\s*[''\"]?[a-z0-9_-]{12,}",
    "password": r"(?i)\bpassword\s*[:=]\s*[''\"]?\S{8,}",
    "jwt": r"\beyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\b",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "connection_string": r"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?)://[^\s]+",
}
_counts = ", ".join(f"len(regexp_extract_all(text, '{rx}')) AS c_{n}" for n, rx in _detectors.items())
_LUHN = ("list_filter(regexp_extract_all(text, '\\b(?:\\d[ -]?){13,19}\\b'), lambda c: length(regexp_replace(c, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND "
         "list_sum(list_transform(range(1, length(regexp_replace(c, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN "
         "CAST(substr(reverse(regexp_replace(c, '[^0-9]', '', 'g')), CAST(i AS INT), 1) AS INT) ELSE "
         "CASE WHEN CAST(substr(reverse(regexp_replace(c, '[^0-9]', '', 'g')), CAST(i AS INT), 1) AS INT) > 4 "
         "THEN CAST(substr(reverse(regexp_replace(c, '[^0-9]', '', 'g')), CAST(i AS INT), 1) AS INT) * 2 - 9 "
         "ELSE CAST(substr(reverse(regexp_replace(c, '[^0-9]', '', 'g')), CAST(i AS INT), 1) AS INT) * 2 END END)) % 10 = 0)")
_names = sorted([*_detectors, "ssn", "credit_card", "email_list"])


@query("p17_sensitive_text", f"""WITH c AS (SELECT doc_id, {_counts},
  len(list_filter(regexp_extract_all(text, '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b'), lambda x: NOT (starts_with(x, '000') OR starts_with(x, '666') OR starts_with(x, '9')))) AS c_ssn,
  len({_LUHN}) AS c_credit_card,
  len(regexp_extract_all(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}\\b')) AS mails FROM documents),
d AS (SELECT *, CASE WHEN mails >= 3 THEN mails ELSE 0 END AS c_email_list FROM c)
SELECT doc_id, CASE WHEN c_aws_key + c_ssn + c_credit_card + c_password > 0 THEN 'highly_confidential'
  WHEN {' + '.join('c_' + n for n in _names)} > 0 THEN 'confidential' ELSE 'public' END AS classification,
  array_to_string(list_filter([{', '.join(f"CASE WHEN c_{n} > 0 THEN '{n}' END" for n in _names)}], lambda x: x IS NOT NULL), ',') AS detectors,
  CAST({' + '.join('c_' + n for n in _names)} AS BIGINT) AS match_count FROM d""")
def p17(spark, sf):
    return text.scan_documents(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", "classification", F.array_join("detectors", ",").alias("detectors"), "match_count")


@query("p18_redacted_log", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(authorization|x-api-key|token|password)=?[^\s,;]+', '\1=[REDACTED]', 'gi'), "
       r"'AKIA[0-9A-Z]{16}', '[REDACTED_AWS_KEY]', 'g')) AS digest FROM documents")
def p18(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.redact("text")).alias("digest"))


@query("p19_catalogue_key", EV + "SELECT event_id, domain AS catalogue_key FROM ev")
def p19(spark, sf):
    return flat_events(spark, sf).select("event_id", text.catalogue_key(
        F.concat(F.lit(" "), F.upper("domain"), F.lit("."))).alias("catalogue_key"))


_STAMP = ("CASE k % 4 WHEN 0 THEN '2024-01-01T00:00:00Z' WHEN 1 THEN '2024-01-01T00:00:00+00:00' WHEN 2 THEN "
          "'2024-01-01T00:00:00+02:00' ELSE '2024-01-01T00:00:00' END")


@query("p20_utc_only", EV + "SELECT event_id, k % 4 IN (0, 1) AS is_utc FROM ev")
def p20(spark, sf):
    return flat_events(spark, sf).select("event_id", contracts.is_utc_text(F.expr(_STAMP)).alias("is_utc"))


_META = ("""concat('{"domain":"', coalesce(domain, ''), '","nested":[{"', CASE k % 7 WHEN 0 THEN 'Password' WHEN 1 THEN 'token' """
         """ELSE 'safe' END, '": 1}],"note":"not a key: secret"}')""")


@query("p21_prohibited_keys", EV + "SELECT event_id, CASE k % 7 WHEN 0 THEN 'password' WHEN 1 THEN 'token' ELSE '' END AS keys, '' AS top_keys FROM ev")
def p21(spark, sf):
    e = flat_events(spark, sf).withColumn("m", F.expr(_META))
    return e.select("event_id", F.array_join(contracts.prohibited_keys("m"), ",").alias("keys"),
                    F.array_join(contracts.prohibited_top_level("m"), ",").alias("top_keys"))


@query("u5_sensitive_key_overlap", EV + "SELECT event_id, k % 7 IN (0, 1) AS has_prohibited_key FROM ev")
def u5(spark, sf):
    e = flat_events(spark, sf).withColumn("m", F.expr(_META))
    return e.select("event_id", (F.size(contracts.prohibited_keys("m")) > 0).alias("has_prohibited_key"))


@query("p22_field_contracts", EV + "SELECT event_id, concat_ws('; ', CASE WHEN k % 11 = 0 THEN 'tenant_id: pattern' END, CASE WHEN k % 13 = 0 THEN 'user_id: length' END, "
       "CASE WHEN k % 4 IN (2, 3) THEN 'occurred_at: utc' END, CASE WHEN k % 17 = 0 THEN 'source: value' END, "
       "CASE k % 7 WHEN 0 THEN 'metadata: prohibited password' WHEN 1 THEN 'metadata: prohibited token' END) AS errors FROM ev")
def p22(spark, sf):
    c = canonical_events(spark, sf).join(flat_events(spark, sf).select("event_id", "k", "domain"), "event_id")
    c = (c.withColumn("metadata", F.expr(_META)).withColumn("occurred_at_text", F.expr(_STAMP))
         .withColumn("tenant_id", F.when(F.col("k") % 11 == 0, "Tenant!").otherwise(F.col("tenant_id")))
         .withColumn("user_id", F.when(F.col("k") % 13 == 0, "u1").otherwise(F.col("user_id")))
         .withColumn("source", F.when(F.col("k") % 17 == 0, "other").otherwise(F.col("source"))))
    return c.select("event_id", F.array_join(contracts.canonical_errors(), "; ").alias("errors"))


CE = """ce AS (SELECT *, CASE WHEN event_type IN ('login_event', 'browser_activity') THEN 'network_access' WHEN event_type = 'file_access'
  THEN 'installed_application' WHEN event_type = 'cloud_upload' THEN 'file_upload' WHEN k % 2 = 0 THEN 'dlp_outcome' ELSE 'file_integrity' END AS kind,
  CASE event_type WHEN 'login_event' THEN 'Windows Logon Success' WHEN 'browser_activity' THEN 'Web request' WHEN 'file_access' THEN 'Package installed' END AS rule,
  k % 15 AS rule_level FROM ev)"""
CEV = S.ctes(S.EV, CE)


@query("p23_security_kind", CEV + "SELECT event_id, CASE WHEN event_type = 'login_event' THEN 'login' WHEN kind IN ('file_upload', 'dlp_outcome') THEN 'transfer' "
       "ELSE 'activity' END AS security_kind FROM ce")
def p23(spark, sf):
    return canonical_events(spark, sf).select("event_id", rules.security_kind(
        "event_type", F.get_json_object("metadata", "$.rule_description")).alias("security_kind"))


@query("p24_security_events", CEV + "SELECT event_id, username AS user_id, department, CASE WHEN event_type = 'login_event' THEN 'login' WHEN kind IN "
       "('file_upload', 'dlp_outcome') THEN 'transfer' ELSE 'activity' END AS event_type, CASE WHEN event_type = 'cloud_upload' THEN bytes_sent ELSE 0 END "
       "AS bytes_transferred, domain FROM ce")
def p24(spark, sf):
    return adapt.security_events(canonical_events(spark, sf)).select(
        "event_id", "user_id", "department", "event_type", "bytes_transferred", "domain")


@query("p25_live_indicator", CEV + "SELECT event_id, CASE WHEN event_type = 'login_event' THEN 'et_login_event' WHEN kind = 'network_access' THEN 'et_browser_activity' "
       "WHEN kind = 'installed_application' THEN 'et_app_install' WHEN kind IN ('file_upload', 'dlp_outcome') THEN 'et_file_transfer' END AS indicator FROM ce")
def p25(spark, sf):
    return canonical_events(spark, sf).select("event_id", rules.live_indicator(
        "event_type", F.get_json_object("metadata", "$.rule_description")).alias("indicator"))


@query("p26_hour_distance", EV + "SELECT event_id, CASE WHEN abs(hour(ts) - 22) > 12 THEN 24 - abs(hour(ts) - 22) ELSE abs(hour(ts) - 22) END AS distance FROM ev")
def p26(spark, sf):
    return flat_events(spark, sf).select("event_id", rules.hour_distance(F.hour("ts"), F.lit(22)).alias("distance"))


@query("p27_z_points", EV + "SELECT event_id, CAST(least(100, greatest(0, round_even((value / 25 - 2) * 25, 0))) AS INT) AS points FROM ev")
def p27(spark, sf):
    return flat_events(spark, sf).select("event_id", rules.z_score_points(F.col("value") / 25).alias("points"))


@query("p28_signal_severity", EV + "SELECT event_id, CASE WHEN k >= 75 THEN 'high' WHEN k >= 50 THEN 'medium' ELSE 'low' END AS severity FROM ev")
def p28(spark, sf):
    return flat_events(spark, sf).select("event_id", rules.signal_severity("k").alias("severity"))


@query("p32_confidence", EV + "SELECT event_id, CASE WHEN k % 10 = 0 THEN 0 ELSE round_even(least(1.0, 0.4 + 0.6 * least(k % 10, 7) / 7), 2) END AS confidence FROM ev")
def p32(spark, sf):
    return flat_events(spark, sf).select("event_id", rules.baseline_confidence(F.col("k") % 10).alias("confidence"))


_SEV = "CASE WHEN k >= 90 THEN 'critical' WHEN k >= 70 THEN 'high' WHEN k >= 40 THEN 'medium' ELSE 'low' END"


@query("p33_event_verdict", EV + f"SELECT event_id, sev AS severity, CASE WHEN k = 0 THEN 'R1' ELSE {S.case_map('sev', fv.ORCHESTRATED_TIER)} END AS tier, "
       f"CASE WHEN k % 9 = 0 THEN '{fv.NO_SIGNAL_TEXT}' ELSE {S.case_map('sev', fv.ORCHESTRATED_ACTION)} || ' Found.' || CASE WHEN k % 2 = 0 THEN "
       "' (baseline confidence 57% -- limited history, treat with extra caution)' ELSE '' END END AS recommendation "
       f"FROM (SELECT *, {_SEV} AS sev FROM ev)")
def p33(spark, sf):
    e = flat_events(spark, sf).withColumn("severity", rules.event_severity("k"))
    found = F.when(F.col("k") % 9 > 0, "Found.")
    conf = F.when(F.col("k") % 2 == 0, 0.57).otherwise(1.0)
    return e.select("event_id", "severity", rules.event_tier("k", "severity").alias("tier"),
                    rules.event_recommendation("severity", found, conf).alias("recommendation"))


@query("p38_cert_signal", S.MATRIX + "SELECT event_id, CASE WHEN is_removable_media = 1 THEN 'is_removable_media' WHEN external_recipient = 1 THEN "
       "'external_recipient' WHEN is_exfil_domain = 1 THEN 'is_exfil_domain' END AS cert_signal FROM fm")
def p38(spark, sf):
    from verification.core_queries import matrix
    return matrix(spark, sf).select("event_id", rules.cert_signal(
        "is_removable_media", "external_recipient", "is_exfil_domain").alias("cert_signal"))
