"""Validity checks. Each returns an error text or NULL, so rows split into good and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.text import col


def is_utc_text(c) -> Column:
    """P20: the raw timestamp text carries ``Z`` or a zero offset."""
    return F.coalesce(col(c).rlike(r"(Z|[+-]00:?00)$"), F.lit(False))


def json_keys(json_text) -> Column:
    """Every object key of a JSON text at any depth, lower case.

    A quoted string before a colon is a key; strings are matched whole, so a
    quoted colon inside a value is not taken for one.
    """
    strings = F.regexp_extract_all(
        F.coalesce(col(json_text), F.lit("")), F.lit(r'"((?:[^"\\]|\\.)*)"\s*(:?)'), 0)
    keys = F.filter(strings, lambda s: F.endswith(s, F.lit(":")))
    return F.transform(keys, lambda s: F.lower(F.regexp_extract(s, r'^"((?:[^"\\]|\\.)*)"', 1)))


def prohibited_keys(json_text, keys=fv.PROHIBITED_KEYS) -> Column:
    """The prohibited keys that occur, sorted."""
    listed = F.array(*[F.lit(k) for k in keys])
    return F.array_sort(F.array_intersect(listed, json_keys(json_text)))


def prohibited_top_level(json_text, keys=fv.PROHIBITED_KEYS_TOP_LEVEL) -> Column:
    """P21, the narrower form: keys of the outer object only."""
    listed = F.array(*[F.lit(k) for k in keys])
    own = F.transform(F.coalesce(F.json_object_keys(col(json_text)), F.array().cast("array<string>")),
                      F.lower)
    return F.array_sort(F.array_intersect(listed, own))


def _length_error(name, low, high) -> Column:
    n = F.length(F.col(name))
    return F.when(n.isNull() | ~n.between(low, high), f"{name}: length")


def canonical_errors(metadata="metadata", occurred_text="occurred_at_text") -> Column:
    """Error array of a canonical event; empty when valid."""
    bad_keys = prohibited_keys(metadata)
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.col("schema_version") == "1.0", F.lit(True)), "schema_version: value"),
        F.when(~F.coalesce(F.col("tenant_id").rlike(fv.TENANT_PATTERN), F.lit(False)), "tenant_id: pattern"),
        _length_error("event_id", 8, 128),
        _length_error("user_id", 8, 128),
        _length_error("device_id", 8, 128),
        F.when(~is_utc_text(occurred_text), "occurred_at: utc"),
        F.when(~F.coalesce(F.col("source").isin(*fv.CANONICAL_SOURCES), F.lit(False)), "source: value"),
        F.when(~F.coalesce(F.col("event_type").isin(*fv.CANONICAL_KINDS), F.lit(False)), "event_type: value"),
        F.when(F.size(bad_keys) > 0,
               F.concat(F.lit("metadata: prohibited "), F.array_join(bad_keys, ", "))),
    ))


def security_errors() -> Column:
    """Error array of a security event."""
    return F.array_compact(F.array(
        _length_error("user_id", 8, 128),
        _length_error("department", 1, 64),
        F.when(F.col("occurred_at").isNull(), "occurred_at: missing"),
        F.when(~F.coalesce(F.col("event_type").isin("login", "activity", "transfer"), F.lit(False)),
               "event_type: value"),
        F.when(F.col("bytes_transferred") < 0, "bytes_transferred: negative"),
        F.when(F.length("domain") > 253, "domain: length"),
    ))


def split_valid(df: DataFrame, errors: Column, id_col: str = "event_id"):
    """(valid rows, quarantine rows of ``id_col`` and ``error``)."""
    checked = df.withColumn("_errors", errors)
    good = checked.where(F.size("_errors") == 0).drop("_errors")
    bad = checked.where(F.size("_errors") > 0).select(
        F.col(id_col), F.array_join("_errors", "; ").alias("error"))
    return good, bad
