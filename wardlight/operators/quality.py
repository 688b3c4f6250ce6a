"""Normalization, de-duplication and quarantine of unified events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.text import canonical_app_name, canonical_domain, strip


def keep_first(events: DataFrame, order="input_ord", existing: DataFrame | None = None,
               keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """First row per key, keys of earlier runs left out.

    The first-row filter also runs before the shuffle, so an id with very many
    copies leaves one row per task. Rows equal in ``order`` are told apart by a hash over
    their columns, so a recomputed task keeps the same one.
    """
    w = Window.partitionBy(*keys).orderBy(order, F.xxhash64(*events.columns))
    first = events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")
    if existing is not None:
        first = first.join(existing.select(*keys), list(keys), "left_anti")
    return first


def normalize(events: DataFrame) -> DataFrame:
    """Canonical names, trimmed identity, filled defaults; adds an ``error`` and two flags."""
    is_net = F.col("event_type").isin(*fv.NETWORK_EVENT_TYPES)
    is_file = F.col("event_type").isin(*fv.FILE_EVENT_TYPES)
    domain = F.when(F.col("destination_domain") != "", canonical_domain("destination_domain")).otherwise(
        F.col("destination_domain"))
    app = F.when(F.col("app_name") != "", canonical_app_name("app_name")).otherwise(F.col("app_name"))

    def differs(a, b):
        return F.coalesce(a != b, F.lit(False))

    def trimmed(c):
        return strip(F.coalesce(F.col(c), F.lit("")))

    renamed = differs(app, F.col("app_name"))
    filled = [(is_net, "bytes_sent"), (is_net, "bytes_received"), (is_file, "file_size_kb"),
              (F.lit(True), "risk_reasons"), (F.lit(True), "mitre_tags"), (F.lit(True), "is_anomaly")]
    n_filled = sum(((cond & F.col(c).isNull()).cast("int") for cond, c in filled[1:]),
                   (filled[0][0] & F.col(filled[0][1]).isNull()).cast("int"))
    bad_identity = (trimmed("username") == "") | (trimmed("client_id") == "")
    error = (F.when(bad_identity, "missing identity field")
             .when(~F.coalesce(F.col("event_type").isin(*fv.EVENT_TYPES), F.lit(False)), "unknown event_type")
             .when(F.col("timestamp").isNull(), "missing timestamp")
             .when(~F.coalesce(F.col("risk_score").between(0, 100), F.lit(True)), "risk_score out of range"))
    replaced = {
        "username": trimmed("username"), "hostname": trimmed("hostname"), "client_id": trimmed("client_id"),
        "destination_domain": domain, "app_name": app,
        "raw_data": F.when(renamed, F.col("raw_data").withField("app_name_original", F.coalesce(
            F.col("raw_data.app_name_original"), F.col("app_name")))).otherwise(F.col("raw_data")),
        "bytes_sent": F.when(is_net, F.coalesce("bytes_sent", F.lit(0))).otherwise(F.col("bytes_sent")),
        "bytes_received": F.when(is_net, F.coalesce("bytes_received", F.lit(0))).otherwise(
            F.col("bytes_received")),
        "file_size_kb": F.when(is_file, F.coalesce("file_size_kb", F.lit(0.0))).otherwise(
            F.col("file_size_kb")),
        "risk_reasons": F.coalesce("risk_reasons", F.array().cast("array<string>")),
        "mitre_tags": F.coalesce("mitre_tags", F.array().cast("array<string>")),
        "is_anomaly": F.coalesce("is_anomaly", F.lit(False)),
    }
    return events.select(
        *[replaced[c].alias(c) if c in replaced else F.col(c) for c in events.columns],
        error.alias("error"), differs(domain, F.col("destination_domain")).alias("domain_changed"),
        renamed.alias("app_changed"), n_filled.alias("n_filled"))


NORMALIZE_FLAGS = ("error", "domain_changed", "app_changed", "n_filled")


def good_rows(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("error").isNull()).drop(*NORMALIZE_FLAGS)


def quarantine_rows(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("error").isNotNull()).select("event_id", "error")


def normalization_statistics(events: DataFrame, normalized: DataFrame) -> DataFrame:
    """Rows in, accepted, quarantined, duplicates, renamed, filled.

    A row that fails its identity check was not yet renamed or filled.
    """
    ok = F.col("error").isNull()
    counts = normalized.agg(
        F.count(F.lit(1)).alias("_kept"), F.count_if(ok).alias("normalized"),
        F.count_if(~ok).alias("quarantined"),
        F.count_if(ok & F.col("app_changed")).alias("app_names_canonicalized"),
        F.count_if(ok & F.col("domain_changed")).alias("domains_canonicalized"),
        F.coalesce(F.sum(F.when(ok, F.col("n_filled"))), F.lit(0)).alias("fields_imputed"))
    return counts.withColumn("total_in", events.agg(F.count(F.lit(1))).scalar()).select(
        "total_in", "normalized", "quarantined",
        (F.col("total_in") - F.col("_kept")).alias("duplicates_dropped"),
        "app_names_canonicalized", "domains_canonicalized", "fields_imputed")


def ingest_status(incoming: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """K7: ``accepted`` or ``duplicate`` per incoming event, replays inside the batch included.

    The first copy is found by a numeric aggregate, so many copies of one id
    never meet in a task.
    """
    first = incoming.groupBy(*keys).agg(F.min("input_ord").alias("_first"))
    known = stored.select(*keys, F.lit(True).alias("_stored")).distinct()
    heads = first.join(known, list(keys), "left")
    again = F.coalesce("_stored", F.lit(False)) | (F.col("input_ord") > F.col("_first"))
    return (incoming.join(heads, list(keys), "left")
            .withColumn("status", F.when(again, "duplicate").otherwise("accepted"))
            .drop("_first", "_stored"))
