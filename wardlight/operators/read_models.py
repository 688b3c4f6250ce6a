"""Read queries an analyst runs on events and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.rules import standing_action
from wardlight.functions.text import clean_marker
from wardlight.operators.ranking import numbered

DAY_US = 86_400_000_000


def risk_halves(events: DataFrame, bucket_us: int = DAY_US) -> DataFrame:
    """Mean risk of the earlier and later half of each user's scored events, and the trend.

    Positions come from day buckets, so a user with very many events is cut by day.
    """
    scored = events.where(F.col("risk_score").isNotNull()).select(
        "username", "event_id", "risk_score", F.unix_micros("timestamp").alias("_us"))
    placed = numbered(scored, ["username"], ["_us", "event_id"], F.floor(F.col("_us") / bucket_us))
    early = F.col("position") < F.floor(F.col("n_rows") / 2)
    halves = placed.groupBy("username").agg(
        F.count(F.lit(1)).alias("n_scored"), F.avg("risk_score").alias("mean_score"),
        F.avg(F.when(early, F.col("risk_score"))).alias("early_mean"),
        F.avg(F.when(~early, F.col("risk_score"))).alias("late_mean"))
    trend = (F.when(F.col("n_scored") < 4, "stable")
             .when(F.col("late_mean") > F.col("early_mean") * 1.15, "rising")
             .when(F.col("late_mean") < F.col("early_mean") * 0.85, "falling").otherwise("stable"))
    return halves.withColumn("risk_trend", trend)


def user_profiles(events: DataFrame, employees: DataFrame, history_days: int = fv.CASB_HISTORY_DAYS,
                  tenant: str = fv.CASB_TENANT) -> DataFrame:
    """One profile per employee; employees without events stay.

    The open-ended lists (domains, applications) are rows of :func:`profile_items`.
    """
    activity = events.groupBy("username").agg(
        F.count(F.lit(1)).alias("_n"),
        F.array_sort(F.collect_set(F.hour("timestamp"))).alias("typical_hours"),
        F.count_if(F.col("raw_data.policy_violation") == 1).alias("total_alerts"),
        F.max("timestamp").alias("last_seen"))
    halves = risk_halves(events).select("username", "mean_score", "risk_trend")
    return (employees.select(F.col("user_id").cast("string").alias("username"),
                             clean_marker("department").alias("department"), clean_marker("role").alias("role"))
            .join(activity, "username", "left").join(halves, "username", "left")
            .select("username", F.lit(tenant).alias("client_id"), "department", "role",
                    F.bround(F.coalesce("_n", F.lit(0)) / history_days, 3).alias("avg_daily_events"),
                    F.coalesce("typical_hours", F.array().cast("array<int>")).alias("typical_hours"),
                    F.bround(F.coalesce("mean_score", F.lit(0.0)), 1).alias("current_risk_score"),
                    F.coalesce("risk_trend", F.lit("stable")).alias("risk_trend"),
                    F.coalesce("total_alerts", F.lit(0)).alias("total_alerts"), "last_seen"))


def profile_items(events: DataFrame) -> DataFrame:
    """Known domains (not shadow IT) and sanctioned applications, one row each."""
    raw = "raw_data."
    domain = F.when((F.coalesce(F.col(raw + "is_shadow_it"), F.lit(0)) == 0)
                    & (F.col("destination_domain") != ""), F.col("destination_domain"))
    app = F.when((F.col(raw + "sanction_status") == "Sanctioned") & (F.col("app_name") != ""), F.col("app_name"))
    both = events.select("username", F.explode(F.array(
        F.struct(F.lit("domain").alias("kind"), domain.alias("item")),
        F.struct(F.lit("app").alias("kind"), app.alias("item")))).alias("x")).select("username", "x.*")
    return both.where(F.col("item").isNotNull()).distinct()


def live_driver_events(rows: DataFrame) -> DataFrame:
    """Per (user, day) the event of the highest rule level; the latest on ties, then the highest id."""
    return rows.groupBy("_username", F.to_date("ts").alias("date")).agg(
        F.max_by("event_id", F.struct("rule_level", "ts", "event_id")).alias("driver_event_id"),
        F.count(F.lit(1)).alias("n_events"))


def severity_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per severity with zeros, plus file-integrity and resolved counts, in one pass."""
    return alerts.agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in fv.SEVERITIES],
        F.count_if(F.col("category") == "file_integrity").alias("file_integrity"),
        F.count_if(F.col("status") == "resolved").alias("resolved"),
        F.count(F.lit(1)).alias("total"))


def new_apps(alerts: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Number of applications first seen within the last days."""
    first = alerts.groupBy("app").agg(F.min("createdAt").alias("first_seen"))
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return first.agg(F.count_if(F.col("first_seen") >= since).alias("new_apps"))


def daily_trend(alerts: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Alerts per day and severity and reviews per day, zero-filled, oldest first."""
    today = F.to_date(F.lit(as_of).cast("timestamp"))
    first = F.date_sub(today, days - 1)
    series = [*fv.SEVERITIES, "reviewed"]
    grid = alerts.sparkSession.range(1).select(
        F.explode(F.sequence(first, today)).alias("day")).select(
        "day", F.explode(F.array(*[F.lit(s) for s in series])).alias("series"))
    created = alerts.select(F.to_date("createdAt").alias("day"), F.col("severity").alias("series"))
    reviewed = alerts.where(F.col("reviewed_at").isNotNull()).select(
        F.to_date("reviewed_at").alias("day"), F.lit("reviewed").alias("series"))
    counts = (created.unionByName(reviewed).where(F.col("day").between(first, today))
              .groupBy("day", "series").agg(F.count(F.lit(1)).alias("n")))
    return (grid.join(counts, ["day", "series"], "left")
            .select("day", "series", F.coalesce("n", F.lit(0)).alias("n")).orderBy("series", "day"))


def application_inventory(alerts: DataFrame) -> DataFrame:
    """Distinct users per application and its first category, most used first.

    Users are counted from (app, user) rows, so a popular application is counted
    in many tasks.
    """
    pairs = alerts.groupBy("app", "category", "userId").agg(
        F.min(F.unix_micros("createdAt")).alias("_first"))
    users = pairs.groupBy("app", "userId").agg(F.min("_first").alias("_first"),
                                               F.min_by("category", F.struct("_first", "category")).alias("category"))
    return users.groupBy("app").agg(
        F.min_by("category", F.struct("_first", "category")).alias("category"),
        F.count(F.lit(1)).alias("active_users")).orderBy(F.desc("active_users"), "app")


def leaderboard(alerts: DataFrame) -> DataFrame:
    """Alerts, highest score and its severity per user, highest first."""
    rank = F.array_position(F.array(*[F.lit(s) for s in fv.SEVERITIES]), F.col("severity"))
    best = alerts.groupBy("userId").agg(
        F.count(F.lit(1)).alias("alert_count"),
        # Score and severity packed in one number keep the hash aggregate.
        F.max(F.col("score") * 10 + rank).alias("_best"))
    return best.select(
        "userId", "alert_count", F.floor(F.col("_best") / 10).cast("int").alias("max_score"),
        F.element_at(F.array(*[F.lit(s) for s in fv.SEVERITIES]), (F.col("_best") % 10).cast("int"))
        .alias("top_severity")).orderBy(F.desc("max_score"), "userId")


def user_trends(alerts: DataFrame, k: int = 6) -> DataFrame:
    """The last k scores of each user, oldest first.

    The k-row limit also runs before the shuffle.
    """
    w = Window.partitionBy("userId").orderBy(F.desc("createdAt"), F.desc("id"))
    last = alerts.select("userId", "createdAt", "id", "score").withColumn(
        "_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return last.groupBy("userId").agg(F.transform(
        F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("o"), "score"))),
        lambda x: x["score"]).alias("trend"))


def user_inventory(alerts: DataFrame) -> DataFrame:
    """Applications seen per user, one row each."""
    return alerts.select("userId", "app").distinct()


def user_alerts(alerts: DataFrame) -> DataFrame:
    """Every alert by user, newest first; a range sort splits busy users."""
    return alerts.orderBy("userId", F.desc("createdAt"), F.desc("id"))


def policy_triggers(alerts: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Categories of the last days with people, severities, summary and standing action."""
    now = F.lit(as_of).cast("timestamp")
    recent = alerts.where(F.col("createdAt") >= now - F.expr(f"INTERVAL {days} DAYS"))
    per_user = recent.groupBy("category", "userId").agg(
        *[F.count_if(F.col("severity") == s).alias(s) for s in fv.SEVERITIES])
    grouped = per_user.groupBy("category").agg(
        F.count(F.lit(1)).alias("affected_users"), *[F.sum(s).alias(s) for s in fv.SEVERITIES])
    # Ties keep the order low to critical.
    dominant = F.array_max(F.array(*[
        F.struct(F.col(s).alias("n"), F.lit(-i).alias("o"), F.lit(s).alias("s"))
        for i, s in enumerate(fv.SEVERITIES)]))["s"]
    people = F.col("affected_users").cast("string")
    noun = F.when(F.col("affected_users") == 1, " employee flagged for ").otherwise(" employees flagged for ")
    return (grouped.withColumn("dominant_severity", dominant)
            .withColumn("total_alerts", F.col("low") + F.col("medium") + F.col("high") + F.col("critical"))
            .withColumn("summary", F.concat(people, noun, F.col("category"), F.lit(" usage this week, mostly "),
                                            F.col("dominant_severity"), F.lit(" severity.")))
            .withColumn("action", standing_action("category"))
            .orderBy(F.desc("affected_users"), "category"))


def approval_mix(apps: DataFrame) -> DataFrame:
    """Safe and untrusted users per category and the safe percentage."""
    safe = F.sum(F.when(F.col("approval") == "sanctioned", F.col("active_users")).otherwise(0))
    grouped = apps.groupBy("category").agg(safe.alias("safe"), F.sum("active_users").alias("total"))
    return (grouped.where(F.col("total") > 0)
            .select("category", "safe", (F.col("total") - F.col("safe")).alias("untrusted"), "total",
                    F.round(F.col("safe") / F.col("total") * 100).cast("int").alias("safe_percent"))
            .orderBy(F.desc("total"), "category"))


def value_mix(df: DataFrame, column: str) -> DataFrame:
    """Rows per value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def latest_heartbeat(heartbeats: DataFrame) -> DataFrame:
    """The newest heartbeat per tenant; of several at one time, the highest by status, count and detail."""
    return heartbeats.groupBy("tenant_id").agg(
        F.max(F.struct("polled_at", "status", "events_found", "detail")).alias("h")
    ).select("tenant_id", "h.*")
