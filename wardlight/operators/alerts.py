"""Alert rows for the dashboard, from user-days and from single events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.text import lookup


def _title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def evidence_items(contributors: str, observed: Column) -> Column:
    """Contributors as {label, detail, observedAt, strength}; unknown ones keep a generic label."""
    labels = {k: v[0] for k, v in fv.FEATURE_EVIDENCE.items()}
    details = {k: v[1] for k, v in fv.FEATURE_EVIDENCE.items()}

    def item(x):
        generic = F.concat(F.lit("Feature '"), x["feature"], F.lit("' deviation: {val}."))
        detail = F.coalesce(lookup(details, x["feature"]), generic)
        return F.struct(
            F.coalesce(lookup(labels, x["feature"]), _title(x["feature"])).alias("label"),
            F.replace(detail, F.lit("{val}"), x["deviation"].cast("string")).alias("detail"),
            observed.alias("observedAt"), F.lit("observed").alias("strength"))

    return F.coalesce(F.transform(contributors, item), F.array())


def parse_contributors(text: str) -> Column:
    """P34 for the text form: ``feature=value; ...`` back to an array of structs."""
    pairs = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"([a-zA-Z_]+)=([\d.]+)"), 0)
    return F.transform(pairs, lambda p: F.struct(
        F.substring_index(p, "=", 1).alias("feature"), F.substring_index(p, "=", -1).alias("deviation")))


def recommendation_sentence() -> Column:
    """Tier label and the first fix."""
    label = F.coalesce(F.col("r_tier_label"), F.lit("Review required"))
    fix = F.get("recommended_fixes", 0)["title"]
    return F.concat(label, F.lit("."), F.coalesce(F.concat(F.lit(" "), fix, F.lit(".")), F.lit("")))


def day_alerts(tiered: DataFrame) -> DataFrame:
    """Alert rows; Informational days and tier R1 are left out."""
    kept = tiered.where((F.col("risk_category") != "Informational") & (F.col("r_tier") != "R1"))
    day = F.date_format("date", "yyyy-MM-dd")
    app = F.coalesce(F.col("shadow_it_category"), _title(F.col("cert_signal")),
                     F.lit("Unclassified activity"))
    department = F.col("department") if "department" in tiered.columns else F.lit("Unclassified")
    return kept.select(
        F.concat(F.lit("AL-"), F.substring(F.sha1(F.concat_ws("-", "_username", day, "_source")), 1, 12))
        .alias("id"),
        F.col("_username").alias("userId"), F.col("_username").alias("userName"),
        department.alias("department"),
        lookup(fv.ALERT_SEVERITY, F.col("risk_category")).alias("severity"),
        F.bround("risk_score").cast("int").alias("score"),
        app.alias("app"), app.alias("category"), F.lit("new").alias("status"),
        F.concat(day, F.lit("T00:00:00Z")).alias("createdAt"),
        F.coalesce(F.col("r_tier"), F.lit("R2")).alias("tier"),
        evidence_items("contributors", F.date_format("date", "HH:mm")).alias("evidence"),
        recommendation_sentence().alias("recommendation"))


def latest_by(df: DataFrame, keys, order) -> DataFrame:
    """The newest row per key; each task passes on one row per key at most."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def event_alerts(events: DataFrame, scores: DataFrame, statuses: DataFrame) -> DataFrame:
    """One alert per canonical event with its score and review status, or the defaults.

    ``scores`` and ``statuses`` hold one row per event (see :func:`latest_by`).
    """
    marked = scores.select("event_id", "score", "severity", "tier", "recommendation", "signals")
    joined = (events.join(marked, "event_id", "left")
              .join(statuses.select("event_id", "status", "reviewed_at"), "event_id", "left"))
    rule = F.get_json_object("metadata", "$.rule_description")
    observed = F.date_format("occurred_at", "HH:mm")

    def item(label, detail):
        return F.struct(label.alias("label"), detail.alias("detail"), observed.alias("observedAt"),
                        F.lit("observed").alias("strength"))

    source = item(F.lit("Source event"), F.coalesce(
        rule, F.concat(F.col("event_type"), F.lit(" event from "), F.col("source"))))
    found = F.coalesce(F.transform("signals", lambda s: item(
        F.coalesce(lookup(fv.SIGNAL_LABEL, s["signal"]), s["signal"]), s["explanation"])), F.array())
    return joined.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("userId"), F.col("user_id").alias("userName"),
        F.lit("Unclassified").alias("department"),
        F.coalesce("severity", F.lit("low")).alias("severity"),
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce(rule, _title(F.col("event_type"))).alias("app"),
        F.col("event_type").alias("category"), F.coalesce("status", F.lit("new")).alias("status"),
        F.col("occurred_at").alias("createdAt"), F.coalesce("tier", F.lit("R1")).alias("tier"),
        F.coalesce("recommendation", F.lit(fv.NOT_SCORED_TEXT)).alias("recommendation"),
        F.concat(F.array(source), found).alias("evidence"), F.col("reviewed_at"))


def search_alerts(alerts: DataFrame, text: str = "", severity: str = "", status: str = "") -> DataFrame:
    """Text in user or app, severity and status; empty means any."""
    if text:
        needle = F.lit(text.lower())
        alerts = alerts.where(F.contains(F.lower("userName"), needle) | F.contains(F.lower("app"), needle))
    if severity:
        alerts = alerts.where(F.col("severity") == severity)
    if status:
        alerts = alerts.where(F.col("status") == status)
    return alerts


def alert_page(alerts: DataFrame, page: int = 1, size: int = fv.PAGE_SIZE) -> DataFrame:
    """L2: one page, newest first, with the total."""
    total = alerts.agg(F.count(F.lit(1)))
    rows = alerts.orderBy(F.desc("createdAt"), "id").offset((page - 1) * size).limit(size)
    return rows.withColumn("total", total.scalar())


def top_risk(alerts: DataFrame, k: int = 3) -> DataFrame:
    """L1: the k highest scores."""
    return alerts.orderBy(F.desc("score"), "id").limit(k)


def related_alerts(alerts: DataFrame, opened: DataFrame) -> DataFrame:
    """The other alerts of the user of each opened alert.

    ``opened`` holds at most one alert per user (the one on screen), so a user's
    alerts are listed once, not paired with each other.
    """
    focus = opened.select("userId", F.col("id").alias("opened_id"))
    return alerts.join(focus, "userId").where(F.col("id") != F.col("opened_id"))
