"""Event features, user-day features and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.rules import live_indicator
from wardlight.functions.text import any_of_rx
from wardlight.operators.ranking import hash_bucket, numbered

METADATA = ("event_id", "ts", "_label", "_source", "_username", "shadow_it_category")


def feature_columns(matrix: DataFrame) -> list[str]:
    """Every column that is not metadata."""
    return [c for c in matrix.columns if c not in METADATA]


def feature_matrix(events: DataFrame) -> DataFrame:
    """One row of 31 features per unified event, in one projection.

    The score, category, reasons and tags of the event are never read: they are
    derived from the label.
    """
    ts, raw = F.col("timestamp"), lambda name: F.col(f"raw_data.{name}")
    hour, dow = F.hour(ts), F.weekday(ts)
    domain = F.coalesce(F.col("destination_domain"), F.lit(""))

    def flag(condition):
        return F.coalesce(condition, F.lit(False)).cast("int")

    def log_size(c):
        return F.when(F.col(c) != 0, F.log1p(F.col(c).cast("double"))).otherwise(0.0)

    def or_sentinel(c):
        return F.coalesce(raw(c).cast("int"), F.lit(fv.SENTINEL))

    return events.select(
        "event_id",
        ts.alias("ts"),
        hour.alias("hour"),
        dow.alias("day_of_week"),
        (dow >= 5).cast("int").alias("is_weekend"),
        ((hour < 7) | (hour >= 19)).cast("int").alias("is_off_hours"),
        *[flag(F.col("event_type") == t).alias(f"et_{t}") for t in fv.INDICATOR_EVENT_TYPES],
        (domain != "").cast("int").alias("has_domain"),
        F.length(domain).alias("domain_len"),
        F.lower(domain).rlike(any_of_rx(fv.EXFIL_DOMAIN_HINTS)).cast("int").alias("is_exfil_domain"),
        log_size("bytes_sent").alias("bytes_sent_log"),
        log_size("bytes_received").alias("bytes_received_log"),
        flag(F.col("file_name") != "").alias("has_file"),
        log_size("file_size_kb").alias("file_size_log"),
        (flag(raw("to_removable_media")).cast("boolean")
         | flag(raw("from_removable_media")).cast("boolean")
         | flag(raw("shadow_it_category") == fv.REMOVABLE_CATEGORY).cast("boolean"))
        .cast("int").alias("is_removable_media"),
        or_sentinel("device_managed").alias("device_managed"),
        or_sentinel("has_admin_rights").alias("has_admin_rights"),
        or_sentinel("security_training_current").alias("security_training_current"),
        flag(raw("auth_method").isin(*fv.WEAK_AUTH_METHODS)).alias("weak_auth"),
        flag(raw("network_zone").isin(*fv.RISKY_NETWORK_ZONES)).alias("risky_network_zone"),
        flag(raw("is_shadow_it") != 0).alias("is_shadow_it"),
        flag(raw("sanction_status") == "Unsanctioned").alias("sanction_unsanctioned"),
        flag(raw("external_recipient")).alias("external_recipient"),
        or_sentinel("is_departing_employee").alias("is_departing_employee"),
        flag(F.col("is_anomaly")).alias("_label"),
        F.col("source").alias("_source"),
        F.col("username").alias("_username"),
        raw("shadow_it_category").alias("shadow_it_category"),
    )


def attach_timestamps(matrix: DataFrame, events: DataFrame) -> DataFrame:
    """Event time for a matrix stored without it; rows without one are dropped.

    The events side is reduced to two columns before the join; a runtime filter
    on the matrix ids prunes the large log.
    """
    times = events.select("event_id", F.col("timestamp").alias("ts"))
    return matrix.join(times, "event_id").where(F.col("ts").isNotNull())


def daily_features(matrix: DataFrame) -> DataFrame:
    """A3: 38 features per (user, source, day); the day is bad if any event is."""
    indicators = [f"et_{t}" for t in fv.INDICATOR_EVENT_TYPES]
    grouped = matrix.groupBy("_username", "_source", F.to_date("ts").alias("date")).agg(
        *[F.sum(c).alias(c) for c in (*indicators, *fv.DAILY_SUM_FEATURES)],
        *[F.max(c).alias(c) for c in fv.DAILY_MAX_FEATURES],
        *[F.avg(c).alias(c) for c in fv.DAILY_MEAN_FEATURES],
        F.count(F.lit(1)).alias("daily_event_count"),
        F.max("_label").alias("_label"),
    )
    count = F.nullif(F.col("daily_event_count"), F.lit(0))
    return grouped.select(
        "*", *[F.coalesce(F.col(c) / count, F.lit(0.0)).alias(f"{c}_share") for c in indicators])


def daily_feature_columns(daily: DataFrame) -> list[str]:
    """The model inputs of a user-day frame."""
    return [c for c in daily.columns if c not in ("_username", "_source", "date", "_label")]


def live_matrix(canonical: DataFrame) -> DataFrame:
    """A4: feature rows of live canonical events, for the same A3 aggregate.

    Columns a live event cannot carry are 0, or the sentinel where 0 would be a
    statement. ``metadata`` is JSON text.
    """
    def meta(path):
        return F.get_json_object("metadata", path)

    kind = live_indicator("event_type", meta("$.rule_description"))
    ts = F.col("occurred_at")
    hour = F.hour(ts)
    query = F.lower(F.coalesce(meta("$.win_eventdata.queryName"), meta("$.domain"), F.lit("")))
    image = F.lower(F.coalesce(meta("$.win_eventdata.image"), F.lit("")))
    sent = F.coalesce(meta("$.bytes_transferred").cast("double"), F.lit(0.0))
    zero = F.lit(0)
    return canonical.select(
        "event_id", ts.alias("ts"),
        *[F.coalesce(kind == f"et_{t}", F.lit(False)).cast("int").alias(f"et_{t}")
          for t in fv.INDICATOR_EVENT_TYPES],
        image.rlike(any_of_rx(fv.LIVE_REMOVABLE_HINTS)).cast("int").alias("is_removable_media"),
        query.rlike(any_of_rx(fv.LIVE_EXFIL_HINTS)).cast("int").alias("is_exfil_domain"),
        *[zero.alias(c) for c in ("has_file", "weak_auth", "risky_network_zone", "is_shadow_it",
                                  "sanction_unsanctioned", "external_recipient")],
        F.log1p(sent).alias("bytes_sent_log"),
        F.lit(0.0).alias("bytes_received_log"), F.lit(0.0).alias("file_size_log"),
        F.length(F.coalesce(meta("$.domain"), F.lit(""))).alias("domain_len"),
        ((hour < 7) | (hour >= 19)).cast("int").alias("is_off_hours"),
        (F.weekday(ts) >= 5).cast("int").alias("is_weekend"),
        *[F.lit(fv.SENTINEL).alias(c)
          for c in ("device_managed", "has_admin_rights", "security_training_current")],
        F.lit(0).alias("_label"), F.col("source").alias("_source"), F.col("user_id").alias("_username"),
        F.coalesce(meta("$.rule_level").cast("int"), F.lit(0)).alias("rule_level"),
    )


def keep_anomalies_sample_normal(matrix: DataFrame, k: int, seed: int = 42,
                                 id_col: str = "event_id") -> DataFrame:
    """Every anomaly and, per source, the k normal rows of lowest hash.

    Hash buckets give the bucket that holds the k-th row; only that bucket is
    numbered row by row, so k may be millions.
    """
    normal = matrix.where(F.col("_label") == 0).withColumn(
        "_hash", F.xxhash64(F.col(id_col), F.lit(seed)))
    ranked = numbered(normal, ["_source"], ["_hash", id_col], hash_bucket("_hash"))
    kept = ranked.where(F.col("position") < k).select(*matrix.columns)
    return matrix.where(F.col("_label") == 1).unionByName(kept)
