"""CASB events and the employee directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.rules import casb_risk_reasons
from wardlight.functions.text import clean_marker, clean_number, lookup
from wardlight.schemas import UNIFIED_EVENT
from wardlight.sources.cert_logs import _columns, _raw_data


def casb_events(spark: SparkSession, path: str) -> DataFrame:
    """CASB CSV as unified events."""
    return convert(spark.read.option("header", True).option("escape", '"').csv(path))


def convert(rows: DataFrame) -> DataFrame:
    """S11 on text rows: activity map, MB to bytes, fields by type, label = incident."""
    def raw(name):
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    def number(name):
        return clean_number(raw(name).try_cast("double"))

    activity = clean_marker(raw("activity_type"))
    kind = F.coalesce(lookup(fv.CASB_ACTIVITY_EVENT_TYPE, activity), F.lit(fv.CASB_DEFAULT_EVENT_TYPE))
    staged = rows.withColumn("_kind", kind).withColumn("_mb", F.nullif(number("data_volume_mb"), F.lit(0.0)))
    k, mb = F.col("_kind"), F.col("_mb")
    is_file = k.isin("file_access", "file_transfer", "cloud_upload")
    is_net = k.isin("network_connection", "dns_query", "browser_activity")
    is_app = k.isin("app_install", "app_launch")
    app = clean_marker(raw("app_name"))

    def text(name):
        return clean_marker(raw(name))

    values = {
        "event_id": raw("event_id"), "timestamp": F.try_to_timestamp(raw("timestamp")),
        "agent_id": F.concat(F.lit("agent-"), raw("user_id")),
        "hostname": F.coalesce(F.nullif(raw("device_id"), F.lit("")), F.concat(raw("user_id"), F.lit("-device"))),
        "username": raw("user_id"), "client_id": F.lit(fv.CASB_TENANT), "event_type": k,
        "source": F.lit(fv.CASB_SOURCE),
        "raw_data": _raw_data(
            shadow_it_category=text("shadow_it_category"), auth_method=text("auth_method"),
            network_zone=text("network_zone"), sanction_status=text("sanction_status"),
            scenario_id=text("scenario_id"), threat_scenario=text("threat_scenario"),
            **{n: number(n) for n in ("device_managed", "has_admin_rights", "security_training_current",
                                      "is_shadow_it", "is_departing_employee", "policy_violation")}),
        "destination_domain": F.when(is_net, text("destination_domain")),
        "bytes_sent": F.when(is_net, (mb * 1024 * 1024).cast("bigint")),
        "file_name": F.when(is_file & app.isNotNull(), F.concat_ws("_", activity, raw("event_id"))),
        "file_size_kb": F.when(is_file, F.bround(mb * 1024, 2)),
        "app_name": F.when(is_app, app), "app_publisher": F.when(is_app, text("app_category")),
        "risk_score": number("risk_score"),
        "risk_category": lookup(fv.CASB_RISK_TIER, text("risk_tier")),
        "risk_reasons": casb_risk_reasons(raw),
        "is_anomaly": F.coalesce(number("is_incident") == 1, F.lit(False)),
        "mitre_tags": F.array().cast("array<string>"),
    }
    return staged.select(*[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in _columns(UNIFIED_EVENT)])


def employees(spark: SparkSession, path: str) -> DataFrame:
    """user_id, department, role."""
    return spark.read.option("header", True).csv(path).select(
        F.col("user_id").cast("string").alias("user_id"), "department", "role")
