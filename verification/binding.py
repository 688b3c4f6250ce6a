"""The test tables in the shapes the operators read.

The binding is one SQL text for both engines, so that a comparison tests the
operators and not the binding. It only renames and derives; no row is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.session import configure

_EVENTS = """
SELECT e.event_id AS eid,
  concat('evt-', lpad(CAST(e.event_id AS {string}), 10, '0')) AS event_id,
  {ts} AS ts, CAST({ts} AS DATE) AS d, e.user_id AS uid,
  concat('user-', lpad(CAST(e.user_id AS {string}), 6, '0')) AS username,
  concat('agent-', lpad(CAST(e.user_id % 50 AS {string}), 4, '0')) AS agent_id,
  concat('tenant-', CAST(e.user_id % 3 AS {string})) AS client_id,
  CASE WHEN e.user_id % 3 = 0 THEN 'casb' ELSE 'cert' END AS source,
  r.r_name AS department,
  CASE e.event_type WHEN 'signup' THEN 'login_event' WHEN 'view' THEN 'browser_activity'
    WHEN 'click' THEN 'file_access' WHEN 'purchase' THEN 'cloud_upload'
    ELSE 'usb_connect' END AS event_type,
  e.value AS value, CAST(floor(e.value * 1024) AS BIGINT) AS bytes_sent, {k} AS k
FROM {events} e JOIN {customer} c ON e.user_id = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
"""

# Fields of the unified event, derived from the number in props.
_UNIFIED = """
SELECT b.*,
  CASE WHEN k >= 95 THEN 1 ELSE 0 END AS label,
  CASE k % 10 WHEN 0 THEN 'dropbox.com' WHEN 1 THEN 'chatgpt.com' WHEN 2 THEN 'drive.google.com'
    WHEN 3 THEN 'files.slack.com' WHEN 4 THEN 'wetransfer.com' WHEN 5 THEN 'perplexity.ai'
    WHEN 6 THEN 'intranet.example.com' WHEN 7 THEN 'github.com' END AS domain,
  CASE WHEN k % 2 = 0 THEN CAST(floor(value * 512) AS BIGINT) END AS bytes_received,
  CASE WHEN event_type IN ('file_access', 'cloud_upload') AND k % 4 <> 3
    THEN concat('doc_', CAST(k AS {string}), '.pdf') END AS file_name,
  CASE WHEN event_type IN ('file_access', 'cloud_upload') AND k % 4 <> 3 THEN value END AS file_size_kb,
  CASE k % 10 WHEN 0 THEN 'Dropbox (Personal)' WHEN 1 THEN 'ChatGPT' WHEN 2 THEN 'Google Drive (Corporate)'
    WHEN 3 THEN 'Slack' WHEN 4 THEN '(beta)' WHEN 5 THEN 'Perplexity ' WHEN 7 THEN 'GitHub' END AS app_name,
  (event_type = 'usb_connect' AND k % 4 = 0) AS to_removable_media,
  (event_type = 'usb_connect' AND k % 4 = 1) AS from_removable_media,
  CASE WHEN source = 'casb' THEN CASE k % 10
    WHEN 0 THEN 'Unapproved Cloud Storage & File Sharing' WHEN 1 THEN 'Unsanctioned AI Tools'
    WHEN 3 THEN 'Unsanctioned Messaging & Collaboration'
    WHEN 4 THEN 'Unapproved Cloud Storage & File Sharing' WHEN 5 THEN 'Unsanctioned AI Tools'
    WHEN 6 THEN 'Removable Media & Offline Transfer' WHEN 8 THEN 'Unauthorized Software Installs'
    WHEN 9 THEN 'Uncharted Category' END END AS shadow_it_category,
  CASE WHEN source = 'casb' THEN k % 2 END AS device_managed,
  CASE WHEN source = 'casb' THEN CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END END AS has_admin_rights,
  CASE WHEN source = 'casb' THEN CASE WHEN k % 5 > 0 THEN 1 ELSE 0 END END AS security_training_current,
  CASE WHEN source = 'casb' THEN CASE k % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'shared_credential'
    WHEN 2 THEN 'sso' ELSE 'mfa' END END AS auth_method,
  CASE WHEN source = 'casb' THEN CASE k % 5 WHEN 0 THEN 'public_wifi' WHEN 1 THEN 'corporate_lan'
    WHEN 2 THEN 'mobile_hotspot' ELSE 'home_network' END END AS network_zone,
  CASE WHEN source = 'casb' THEN CASE WHEN k % 10 IN (1, 4, 5) THEN 1 ELSE 0 END END AS is_shadow_it,
  CASE WHEN source = 'casb' THEN CASE WHEN k % 10 IN (0, 4) THEN 'Unsanctioned'
    WHEN k % 10 IN (2, 3, 7) THEN 'Sanctioned' END END AS sanction_status,
  CASE WHEN source = 'cert' THEN k % 9 = 0 END AS external_recipient,
  CASE WHEN source = 'casb' THEN CASE WHEN uid % 10 = 0 THEN 1 ELSE 0 END END AS is_departing_employee,
  CASE WHEN source = 'casb' AND k >= 95 THEN concat('S', CAST(k % 3 + 1 AS {string})) END AS scenario_id,
  CASE WHEN source = 'casb' AND k >= 95 THEN concat('Scenario ', CAST(k % 3 + 1 AS {string})) END AS threat_scenario,
  CASE WHEN source = 'casb' THEN CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END END AS policy_violation
FROM ({base}) b
"""

_SPARK = {"string": "STRING", "ts": "CAST(e.ts AS TIMESTAMP)",
          "k": "CAST(get_json_object(e.props, '$.k') AS INT)"}
_DUCK = {"string": "VARCHAR", "ts": "e.ts", "k": "CAST(json_extract_string(e.props, '$.k') AS INT)",
         "events": "events", "customer": "customer", "nation": "nation", "region": "region"}


def duck_events_sql() -> str:
    """The flat event binding for the check engine."""
    return _UNIFIED.format(string="VARCHAR", base=_EVENTS.format(**_DUCK))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows with every derived field as a plain column."""
    configure(spark)
    frames = {n: table(spark, sf_dir, n) for n in ("events", "customer", "nation", "region")}
    names = {n: "{" + n + "}" for n in frames}
    base = _EVENTS.format(**_SPARK, **names)
    return spark.sql(_UNIFIED.format(string="STRING", base=base), **frames)


_RAW = ("to_removable_media", "from_removable_media", "shadow_it_category", "device_managed",
        "has_admin_rights", "security_training_current", "auth_method", "network_zone",
        "is_shadow_it", "sanction_status", "external_recipient", "is_departing_employee",
        "scenario_id", "threat_scenario", "policy_violation")


def unified_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as unified events (28 fields)."""
    e = flat_events(spark, sf_dir)

    def null(kind):
        return F.lit(None).cast(kind)

    return e.select(
        "event_id", F.col("ts").alias("timestamp"), "agent_id",
        F.concat(F.lit("host-"), F.col("agent_id")).alias("hostname"), "username", "client_id",
        "event_type", "source",
        F.struct(*[F.col(c) for c in _RAW], null("string").alias("app_name_original")).alias("raw_data"),
        null("string").alias("destination_ip"), F.col("domain").alias("destination_domain"),
        null("int").alias("destination_port"), "bytes_sent", "bytes_received",
        null("string").alias("mac_address"), null("string").alias("device_status"),
        null("string").alias("file_path"), "file_name", "file_size_kb",
        null("string").alias("file_extension"), "app_name", null("string").alias("app_version"),
        null("string").alias("app_publisher"),
        F.when(F.col("k") % 11 != 0, F.col("k").cast("double")).alias("risk_score"),
        null("string").alias("risk_category"), null("array<string>").alias("risk_reasons"),
        (F.col("label") == 1).alias("is_anomaly"), null("array<string>").alias("mitre_tags"))


def canonical_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as canonical events with JSON metadata."""
    e = flat_events(spark, sf_dir)
    kind = (F.when(F.col("event_type").isin("login_event", "browser_activity"), "network_access")
            .when(F.col("event_type") == "file_access", "installed_application")
            .when(F.col("event_type") == "cloud_upload", "file_upload")
            .otherwise(F.when(F.col("k") % 2 == 0, "dlp_outcome").otherwise("file_integrity")))
    rule = (F.when(F.col("event_type") == "login_event", "Windows Logon Success")
            .when(F.col("event_type") == "browser_activity", "Web request")
            .when(F.col("event_type") == "file_access", "Package installed"))
    metadata = F.to_json(F.struct(
        F.col("department").alias("department"), F.col("domain").alias("domain"),
        F.when(F.col("event_type") == "cloud_upload", F.col("bytes_sent")).alias("bytes_transferred"),
        rule.alias("rule_description"), (F.col("k") % 15).alias("rule_level"),
        F.struct(F.col("domain").alias("queryName"),
                 F.when(F.col("to_removable_media"), F.lit("E:\\copy.exe")).alias("image"))
        .alias("win_eventdata")))
    return e.select(
        F.lit("1.0").alias("schema_version"), F.col("client_id").alias("tenant_id"), "event_id",
        F.col("ts").alias("occurred_at"), F.col("username").alias("user_id"),
        F.concat(F.lit("dev-"), F.col("agent_id")).alias("device_id"),
        F.lit("wazuh").alias("source"), kind.alias("event_type"), metadata.alias("metadata"))


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event rows as security events (login, activity, transfer)."""
    e = flat_events(spark, sf_dir)
    kind = (F.when(F.col("event_type") == "login_event", "login")
            .when(F.col("event_type") == "cloud_upload", "transfer").otherwise("activity"))
    return e.select("event_id", F.col("client_id").alias("tenant_id"), F.col("username").alias("user_id"),
                    "department", F.col("ts").alias("occurred_at"), kind.alias("event_type"),
                    F.col("bytes_sent").alias("bytes_transferred"), "domain")
