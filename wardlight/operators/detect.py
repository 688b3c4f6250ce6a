"""Per-event detectors against stored baselines, and their combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions import rules
from wardlight.functions.text import domain_token

PROFILES = ("package", "engine")


def signal(name: str, condition: Column, score, evidence: dict, severity=None) -> Column:
    """struct(signal, severity, score, explanation, evidence), or NULL if it did not fire."""
    score = score if isinstance(score, Column) else F.lit(score)
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    return F.when(condition, F.struct(
        F.lit(name).alias("signal"),
        (F.lit(severity) if severity else rules.signal_severity(score)).alias("severity"),
        score.cast("int").alias("score"), F.lit(fv.EXPLANATION[name]).alias("explanation"),
        F.create_map(*pairs).alias("evidence")))


def _z_signal(name, condition, z, evidence) -> Column:
    return signal(name, F.coalesce(condition & (z >= fv.Z_ALERT), F.lit(False)),
                  rules.z_score_points(z), {"robust_z": F.round(z, 2), **evidence})


def attach_baselines(events: DataFrame, users: DataFrame, peers: DataFrame,
                     known: DataFrame, key: str) -> DataFrame:
    """Stored user and peer baseline and whether the domain is known, by left joins."""
    own = users.select(
        "user_id", F.lit(True).alias("has_baseline"), "sample_days", "login_samples",
        "login_hour_centre", "login_hour_scale", "daily_volume_median", "daily_volume_scale")
    cohort = peers.select("department", F.col("daily_volume_median").alias("peer_median"),
                          F.col("daily_volume_scale").alias("peer_scale"), "cohort_size")
    return (events.withColumn("domain_token", domain_token("domain", key))
            .join(own, "user_id", "left")
            .join(known.select("user_id", "domain_token", F.lit(True).alias("domain_known")),
                  ["user_id", "domain_token"], "left")
            .join(cohort, "department", "left"))


def behaviour_signals(profile: str) -> list[Column]:
    """M4-M7 as columns over :func:`attach_baselines` (or point-in-time) rows."""
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    package = profile == "package"
    has = F.coalesce("has_baseline", F.lit(False))
    moved = F.coalesce("bytes_transferred", F.lit(0))
    kind = F.col("event_type")

    hour = F.hour("occurred_at") + F.minute("occurred_at") / 60.0
    distance = rules.hour_distance(hour, F.col("login_hour_centre"))
    timed = has & (kind == "login") & F.col("login_hour_centre").isNotNull()
    if package:
        timed = timed & (F.col("login_samples") >= fv.MIN_LOGIN_SAMPLES)
    late = {"distance_hours": F.round(distance, 2)}
    if package:
        late["samples"] = F.col("login_samples")
    time_signal = _z_signal("time_anomaly", timed, distance / F.col("login_hour_scale"), late)

    volume = has & (moved > 0)
    volume = volume & ((F.col("sample_days") >= fv.MIN_VOLUME_DAYS) if package
                       else kind.isin("activity", "transfer"))
    facts = ({"bytes_transferred": moved, "baseline_days": F.col("sample_days")} if package
             else {"bytes": moved})
    volume_signal = _z_signal("volume_anomaly", volume,
                              F.abs(moved - F.col("daily_volume_median")) / F.col("daily_volume_scale"), facts)

    fresh = has & F.col("domain_token").isNotNull() & F.col("domain_known").isNull()
    if package:
        fresh = fresh & (F.col("sample_days") >= 1)
        facts = {"domain_hash": F.col("domain_token"), "baseline_days": F.col("sample_days")}
    else:
        facts = {"new_for_user": F.lit(True)}
    domain_signal = signal("new_domain", fresh, fv.NEW_DOMAIN_SCORE[profile], facts, "low")

    peer = (F.col("cohort_size") >= fv.MIN_PEER_COHORT) & (moved > 0)
    if not package:
        peer = peer & has
    peer_signal = _z_signal("peer_comparison", peer,
                            F.abs(moved - F.col("peer_median")) / F.col("peer_scale"),
                            {"cohort_size": F.col("cohort_size")})
    if package:
        return [domain_signal, time_signal, volume_signal, peer_signal]
    return [time_signal, volume_signal, domain_signal, peer_signal]


def policy_signals() -> list[Column]:
    """M8: catalogue policy over rows with ``app`` and ``app_known`` columns."""
    named = F.col("domain").isNotNull()
    app = F.col("app")
    weight = app["risk_weight"]
    return [
        signal("unknown_application", named & app.isNull(), 0, {"review_required": F.lit(True)}, "low"),
        signal("unapproved_app", app["approval_state"] == "unapproved", weight,
               {"application": app["name"], "category": app["category"],
                "policy_state": app["approval_state"]}),
        signal("ai_tool_first_use",
               (app["category"] == "ai") & ~F.coalesce("app_known", F.lit(False)),
               fv.AI_FIRST_USE_SCORE, {"application": app["name"], "category": F.lit("ai"),
                                       "first_use": F.lit(True)}, "low"),
    ]


def sensitive_signal() -> Column:
    """M9: outcome of the text scan, over detectors, match_count and classification."""
    fired = (F.col("event_type") == "dlp_outcome") & (F.size("detectors") > 0) & (F.col("match_count") > 0)
    score = F.when(F.col("classification") == "highly_confidential", fv.SENSITIVE_SCORE_HIGH).otherwise(
        fv.SENSITIVE_SCORE)
    return signal("sensitive_upload", F.coalesce(fired, F.lit(False)), score,
                  {"classification": F.col("classification"),
                   "detectors": F.array_join("detectors", ","), "match_count": F.col("match_count")})


def with_signals(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """The signals that fired, in order, as an array column."""
    return rows.withColumn("signals", F.array_compact(F.array(*columns)))


def orchestrate(detected: DataFrame) -> DataFrame:
    """Strongest signal times baseline confidence, with severity, tier and text."""
    top = F.coalesce(F.array_max(F.transform("signals", lambda s: s["score"])), F.lit(0))
    staged = detected.withColumn("_top", top)
    staged = staged.withColumn("_primary", F.expr("get(filter(signals, s -> s.score = _top), 0)"))
    staged = staged.withColumn("confidence", rules.baseline_confidence("sample_days"))
    staged = staged.withColumn("score", F.bround(F.col("_top") * F.col("confidence")).cast("int"))
    staged = staged.withColumn("severity", rules.event_severity("score"))
    return (staged.withColumn("tier", rules.event_tier("score", "severity"))
            .withColumn("recommendation", rules.event_recommendation(
                "severity", F.col("_primary.explanation"), "confidence"))
            .drop("_top", "_primary"))


def detect_engine(events: DataFrame, users: DataFrame, peers: DataFrame, known: DataFrame,
                  key: str) -> DataFrame:
    """M10/M11 with the stored-baseline rule set."""
    rows = attach_baselines(events, users, peers, known, key)
    return orchestrate(with_signals(rows, behaviour_signals("engine")))
