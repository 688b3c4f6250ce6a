"""SIEM alerts and index hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.rules import siem_event_kind, technique_note, technique_tag
from wardlight.functions.text import blank_to_null, department_of_host, windows_user
from wardlight.schemas import SIEM_ALERT, SIEM_HIT
from wardlight.sources.dimensions import siem_rules


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIEM_ALERT).json(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIEM_HIT).json(path)


def siem_events(alerts: DataFrame, tenant: str) -> DataFrame:
    """Alerts of known rules as events; the rule table is 12 fixed rows."""
    rules = siem_rules(alerts.sparkSession)
    joined = alerts.join(F.broadcast(rules), F.col("rule.id") == F.col("rule_id"))
    tag = technique_tag("shadow_it_category", "cert_signal")
    reported = F.get(F.col("rule.mitre.id"), 0)
    return joined.withColumn("_tag", tag).select(
        F.coalesce("id", F.concat(F.lit(f"{fv.SIEM_SOURCE}-"), F.col("rule_id"), F.lit("-"), F.col("timestamp")))
        .alias("event_id"),
        F.try_to_timestamp("timestamp").alias("timestamp"),
        F.coalesce("agent.id", F.lit("unknown")).alias("agent_id"),
        F.coalesce("agent.name", F.lit("unknown")).alias("hostname"),
        windows_user("data.win.eventdata.user").alias("username"), F.lit(tenant).alias("client_id"),
        F.col("rule_event_type").alias("event_type"), F.lit(fv.SIEM_SOURCE).alias("source"),
        F.col("data.win.eventdata.queryName").alias("destination_domain"),
        F.col("rule_id"), F.col("rule.level").alias("rule_level"),
        F.col("rule.description").alias("rule_description"), F.col("rule.groups").alias("rule_groups"),
        F.col("data.win.eventdata.image").alias("process_image"), "shadow_it_category",
        department_of_host("agent.name").alias("department"), F.col("_tag").alias("mitre_tag"),
        technique_note(reported, "_tag").alias("mitre_note"), F.array("_tag").alias("mitre_tags"))


def unknown_rules(alerts: DataFrame) -> DataFrame:
    """Alerts left out because their rule is unknown, per rule id."""
    rules = siem_rules(alerts.sparkSession)
    left_out = alerts.join(F.broadcast(rules), F.col("rule.id") == F.col("rule_id"), "left_anti")
    return left_out.groupBy(F.col("rule.id").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))


def hit_events(hits: DataFrame, tenant: str) -> DataFrame:
    """Index hits as canonical events; the Windows event data goes along."""
    s = "_source."
    user = F.coalesce(blank_to_null(s + "data.dstuser"), blank_to_null(s + "data.srcuser"),
                      F.col(s + "agent.name"), F.lit("unknown"))
    metadata = F.to_json(F.struct(
        F.col(s + "rule.id").alias("rule_id"), F.col(s + "rule.description").alias("rule_description"),
        F.col(s + "rule.level").alias("rule_level"), F.col(s + "agent.name").alias("agent_name"),
        F.col(s + "full_log").alias("raw_log"), F.col(s + "data.win.eventdata").alias("win_eventdata")))
    return hits.select(
        F.lit("1.0").alias("schema_version"), F.lit(tenant).alias("tenant_id"), F.col("_id").alias("event_id"),
        F.try_to_timestamp(s + "timestamp").alias("occurred_at"),
        F.concat(F.lit("user-"), user).alias("user_id"),
        F.concat(F.lit("agent-"), F.coalesce(F.col(s + "agent.id"), F.lit("unknown"))).alias("device_id"),
        F.lit(fv.SIEM_SOURCE).alias("source"),
        siem_event_kind(s + "rule.groups", s + "full_log").alias("event_type"), metadata.alias("metadata"))
