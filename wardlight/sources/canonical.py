"""Canonical event lines, collector records and unified event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.contracts import canonical_errors, split_valid
from wardlight.functions.text import lookup
from wardlight.schemas import CANONICAL_LINE, COLLECTOR_LINE, UNIFIED_EVENT


def read_canonical(spark: SparkSession, path: str):
    """(valid events, quarantine) of canonical event lines."""
    return check_canonical(spark.read.schema(CANONICAL_LINE).json(path))


def check_canonical(lines: DataFrame):
    """S17/P20-P22 over text fields; ``occurred_at`` becomes a timestamp in valid rows."""
    staged = lines.withColumnRenamed("occurred_at", "occurred_at_text")
    good, bad = split_valid(staged, canonical_errors())
    return good.withColumn("occurred_at", F.try_to_timestamp("occurred_at_text")).select(
        "schema_version", "tenant_id", "event_id", "occurred_at", "user_id", "device_id", "source",
        "event_type", F.coalesce("metadata", F.lit("{}")).alias("metadata")), bad


def read_collector(spark: SparkSession, path: str, tenant: str) -> DataFrame:
    return collector_events(spark.read.schema(COLLECTOR_LINE).json(path), tenant)


def collector_events(records: DataFrame, tenant: str) -> DataFrame:
    """Collector records as canonical events with the metadata of their kind.

    The id is a hash over the content and, from the second equal record on, its number
    among its equals: line numbers do not exist in a split file. Equal records are counted
    before the shuffle and dealt out again, so each stays an event, with the same ids in every run.
    """
    kind = F.col("kind")
    metadata = (
        F.when(kind == "browser", F.to_json(F.struct("domain", F.coalesce(
            "duration_seconds", F.lit(0)).alias("duration_seconds"))))
        .when(kind == "installed_app", F.to_json(F.struct("publisher", "product", F.coalesce(
            "version", F.lit("unknown")).alias("version"))))
        .when(kind == "upload", F.to_json(F.struct("domain", "bytes_transferred")))
        .when(kind == "dlp", F.to_json(F.struct("classification", "detectors", "match_count"))))
    identity = F.concat_ws(":", F.lit(tenant), "timestamp", "user", "device", "kind", metadata)
    counted = records.where(kind.isin(*fv.COLLECTOR_KINDS)).select(
        "timestamp", "user", "device", "kind", metadata.alias("metadata"), identity.alias("_identity")
    ).groupBy("_identity", "timestamp", "user", "device", "kind", "metadata").agg(F.count(F.lit(1)).alias("_n"))
    copy = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)).alias("_copy")
    number = F.when(F.col("_copy") > 0, F.concat(F.lit("#"), F.col("_copy").cast("string"))).otherwise("")
    return counted.select("*", copy).select(
        F.lit("1.0").alias("schema_version"), F.lit(tenant).alias("tenant_id"),
        F.concat(F.lit("evt-"), F.sha1(F.concat("_identity", number))).alias("event_id"),
        F.col("timestamp").alias("occurred_at"), F.col("user").alias("user_id"), F.col("device").alias("device_id"),
        F.lit("simulator").alias("source"), lookup(fv.COLLECTOR_KINDS, F.col("kind")).alias("event_type"), "metadata")


def read_unified(spark: SparkSession, path: str, multiline: bool = False):
    """(parsed rows, quarantine) of unified event files, JSON lines or arrays.

    Lines that are no JSON, or lack an id, time or type, go to quarantine.
    """
    raw = (spark.read.schema(UNIFIED_EVENT + ", _corrupt_record string").option("mode", "PERMISSIVE")
           .option("multiLine", multiline).json(path))
    broken = (F.col("_corrupt_record").isNotNull() | F.col("event_id").isNull()
              | F.col("timestamp").isNull() | ~F.coalesce(F.col("event_type").isin(*fv.EVENT_TYPES), F.lit(False)))
    checked = raw.withColumn("_broken", broken)
    bad = checked.where("_broken").select("event_id", F.lit("parse/validate").alias("error"))
    return checked.where("NOT _broken").drop("_broken", "_corrupt_record"), bad
