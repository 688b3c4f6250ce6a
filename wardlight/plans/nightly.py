"""Nightly jobs over a trailing window; ``run_ts`` is an argument, not the clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.rules import category
from wardlight.functions.text import lookup
from wardlight.operators.features import daily_features, live_matrix
from wardlight.operators.read_models import live_driver_events
from wardlight.operators.robust import known_domains, peer_baselines, robust_user_baselines
from wardlight.operators.tiers import filled
from wardlight.plans.adapt import security_events
from wardlight.session import materialize
from wardlight.sources.sinks import append_scores, write_baselines
from wardlight.streaming.tables import Pointer


def trailing(events: DataFrame, run_ts, days: int = fv.BASELINE_WINDOW_DAYS, ts: str = "occurred_at") -> DataFrame:
    """Rows of the last ``days`` before ``run_ts``; a plain range, so it reaches the scan."""
    now = F.lit(run_ts).cast("timestamp")
    return events.where((F.col(ts) >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= now))


def refresh_baselines(canonical: DataFrame, run_ts, key: str, days: int = fv.BASELINE_WINDOW_DAYS):
    """(user baselines, peer baselines, known domains) of the trailing window."""
    events = security_events(trailing(canonical, run_ts, days))
    users = robust_user_baselines(events)
    return users, peer_baselines(users), known_domains(events, key)


class BaselineStore:
    """K6: versions of the three baseline tables below one folder; a pointer names the one in force.

    Readers ask ``current`` whenever they need the baselines: a version is written in full before the
    pointer moves, and is never changed afterwards.
    """

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root, key
        self.pointer = Pointer(spark, f"{root}/_current")

    def current(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(user baselines, peer baselines, known domains) in force."""
        version = self.pointer.get()
        if version is None:
            raise ValueError(f"no baselines published below {self.root}")
        return tuple(self.spark.read.parquet(f"{self.root}/{name}/version={version}") for name in ("users", "peers", "known"))

    def refresh(self, canonical: DataFrame, run_ts, version: str, days: int = fv.BASELINE_WINDOW_DAYS) -> tuple:
        """Recompute the trailing window, keep users outside it, publish; returns the new tables.

        Departments are recomputed from all users that are kept. Running a version again replaces it.
        """
        users, _, known = refresh_baselines(canonical, run_ts, self.key, days)
        old = self.current() if self.pointer.get() not in (None, version) else None
        write_baselines(users, f"{self.root}/users", version, "user_id", old[0] if old else None)
        users = self.spark.read.parquet(f"{self.root}/users/version={version}")
        write_baselines(peer_baselines(users), f"{self.root}/peers", version, "department")
        # A user's known domains are replaced as a whole, as its baseline row is.
        kept = old[2].join(known.select("user_id").distinct(), "user_id", "left_anti") if old else None
        write_baselines(known.unionByName(kept) if old else known, f"{self.root}/known", version, "user_id")
        self.pointer.move(version)
        return self.current()


def refresh_counts(canonical: DataFrame, run_ts, days: int = fv.BASELINE_WINDOW_DAYS) -> DataFrame:
    """Events considered and adapted, users and departments recomputed."""
    window = trailing(canonical, run_ts, days)
    adapted = security_events(window)
    # Last department per user decides, as in the baselines.
    per_user = (adapted.groupBy("user_id", "department").agg(
        F.max(F.unix_micros("occurred_at")).alias("_last"), F.count(F.lit(1)).alias("_n"))
        .groupBy("user_id").agg(F.max_by("department", F.struct("_last", "department")).alias("department"),
                                F.sum("_n").alias("_n")))
    by_department = per_user.groupBy("department").agg(F.count(F.lit(1)).alias("_users"), F.sum("_n").alias("_n"))
    return by_department.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("events_adapted"),
        F.coalesce(F.sum("_users"), F.lit(0)).alias("users_recomputed"),
        F.count(F.lit(1)).alias("departments_recomputed")).withColumn(
        "events_considered", window.agg(F.count(F.lit(1))).scalar())


def observed(df: DataFrame, name: str):
    """A23 while writing: (frame, observation) that counts the rows as they pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def live_user_days(canonical: DataFrame, run_ts, days: int = fv.BASELINE_WINDOW_DAYS) -> DataFrame:
    """A4: user-day features of the trailing window, by the same aggregate as training."""
    return daily_features(live_matrix(trailing(canonical, run_ts, days)))


def user_day_results(scored_days: DataFrame, drivers: DataFrame, cutoffs=fv.SCORER_CUTOFFS) -> DataFrame:
    """One result per user-day above Informational, attached to its driver event.

    ``scored_days`` has ``classifier_score`` per (_username, date).
    """
    risk = category("classifier_score", cutoffs)
    points = F.bround(F.col("classifier_score") * 100).cast("int")
    joined = scored_days.join(drivers, ["_username", "date"]).withColumn("risk_category", risk)
    kept = joined.where(F.col("risk_category") != "Informational")
    base = lookup(fv.BASE_TIER, F.col("risk_category"))
    label = lookup(fv.TIER_LABEL, base)
    severity = lookup(fv.ALERT_SEVERITY, F.col("risk_category"))
    explanation = filled(fv.MODEL_FINDING_TEXT, F.col("risk_category"), F.col("n_events").cast("string"),
                         F.col("driver_event_id"), label)
    reason = filled(fv.BASE_TIER_TEXT, F.col("risk_category"), base, label)
    finding = F.struct(
        F.lit(fv.MODEL_FINDING_SIGNAL).alias("signal"), severity.alias("severity"), points.alias("score"),
        explanation.alias("explanation"),
        F.create_map(F.lit("daily_event_count"), F.col("n_events").cast("string"),
                     F.lit("driver_event_id"), F.col("driver_event_id"),
                     F.lit("raw_model_probability"), F.round("classifier_score", 4).cast("string")).alias("evidence"))
    return kept.select(
        F.col("driver_event_id").alias("event_id"), "_username", "date", "risk_category", points.alias("score"),
        severity.alias("severity"), base.alias("tier"), F.concat(label, F.lit(". "), reason).alias("recommendation"),
        F.array(finding).alias("signals"), F.lit(1.0).alias("confidence"))


def score_user_days(canonical: DataFrame, model, run_ts, days: int = fv.BASELINE_WINDOW_DAYS,
                    cutoffs=fv.SCORER_CUTOFFS) -> DataFrame:
    """Trailing user-days, model, category, tier and driver event."""
    from wardlight.operators.models import score_days

    window = trailing(canonical, run_ts, days)
    scored = score_days(model, daily_features(live_matrix(window)))
    return user_day_results(scored, live_driver_events(live_matrix(window)), cutoffs)


def publish_user_days(canonical: DataFrame, model, run_ts, scores_path: str, days: int = fv.BASELINE_WINDOW_DAYS,
                      cutoffs=fv.SCORER_CUTOFFS) -> DataFrame:
    """User-day results appended to the event scores, and one row of counts.

    A result replaces the per-event score of its driver event, since readers take the newest row of an
    event. Counted are the events considered, the user-days scored and those that stay
    Informational and are skipped.
    """
    from wardlight.operators.models import score_days

    spark, window = canonical.sparkSession, trailing(canonical, run_ts, days)
    scored = materialize(spark, score_days(model, daily_features(live_matrix(window))), "scored-days")
    results = user_day_results(scored, live_driver_events(live_matrix(window)), cutoffs)
    rows, written = observed(results.withColumn("computed_at", F.current_timestamp()), "user-days")
    append_scores(rows, scores_path)
    n = F.lit(written.get["rows"]).cast("bigint")
    return scored.agg(F.count(F.lit(1)).alias("_days")).select(
        window.agg(F.count(F.lit(1))).scalar().alias("events_considered"), n.alias("user_days_scored"),
        (F.col("_days") - n).alias("user_days_informational_skipped"))


def backfill_targets(events: DataFrame, scores: DataFrame, rescore_all: bool = False) -> DataFrame:
    """Events without a score, or every event."""
    return events if rescore_all else events.join(scores.select("event_id"), "event_id", "left_anti")
