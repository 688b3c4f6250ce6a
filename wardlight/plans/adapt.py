"""Canonical events as security events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.contracts import security_errors
from wardlight.functions.rules import security_kind
from wardlight.functions.text import blank_to_null, catalogue_key


def security_events(canonical: DataFrame) -> DataFrame:
    """The fields the detectors read; rows that break the contract are left out.

    Department, bytes and domain are taken from the metadata where present, else
    the defaults (one department, 0 bytes, no domain).
    """
    def meta(path):
        return F.get_json_object("metadata", path)

    projected = canonical.select(
        "event_id", "tenant_id", "user_id",
        F.coalesce(meta("$.department"), F.lit(fv.DEFAULT_DEPARTMENT)).alias("department"), "occurred_at",
        security_kind("event_type", meta("$.rule_description")).alias("event_type"),
        F.coalesce(meta("$.bytes_transferred").cast("bigint"), F.lit(0)).alias("bytes_transferred"),
        blank_to_null(catalogue_key(meta("$.domain"))).alias("domain"))
    return projected.where(F.size(security_errors()) == 0)
