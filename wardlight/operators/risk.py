"""User-day risk: aggregates, driver event, composite score, category."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.rules import category, category_by_source, cert_signal
from wardlight.operators.baselines import contributors_of, render_contributors
from wardlight.operators.features import feature_columns
from wardlight.operators.ranking import percentile_rank

DAY = ("_username", "_source", "date")


def daily_risk_inputs(scores: DataFrame) -> DataFrame:
    """Score aggregates and the driver event of each user-day, in one pass.

    The driver is the event of the highest score; ties go to the lowest id. Its
    contributors are ranked after the choice, once per user-day.
    """
    features = feature_columns(scores.drop("anomaly_score", "deviation_codes"))
    signal = cert_signal("is_removable_media", "external_recipient", "is_exfil_domain")
    payload = F.struct("event_id", "deviation_codes", "shadow_it_category", signal.alias("cert_signal"))
    daily = scores.groupBy("_username", "_source", F.to_date("ts").alias("date")).agg(
        F.max("anomaly_score").alias("daily_max_score"),
        F.avg("anomaly_score").alias("daily_mean_score"),
        F.count(F.lit(1)).alias("daily_event_count"),
        F.sum("_label").alias("daily_labeled_anomaly_count"),
        F.min_by(payload, F.struct(-F.col("anomaly_score"), F.col("event_id"))).alias("_driver"))
    daily = daily.withColumn("contributors", contributors_of("_driver.deviation_codes", features))
    return daily.select(
        *DAY, "daily_max_score", "daily_mean_score", "daily_event_count",
        "daily_labeled_anomaly_count", F.col("_driver.event_id").alias("driver_event_id"),
        F.col("contributors"), render_contributors("contributors").alias("top_contributors"),
        F.col("_driver.shadow_it_category").alias("shadow_it_category"),
        F.col("_driver.cert_signal").alias("cert_signal"))


def attach_model_scores(daily: DataFrame, model_scores: DataFrame) -> DataFrame:
    """Classifier probability per user-day; 0 where the model has none."""
    scores = model_scores.select(*DAY, "classifier_score")
    return daily.join(scores, list(DAY), "left").withColumn(
        "classifier_score", F.coalesce("classifier_score", F.lit(0.0)))


def risk_scores(daily: DataFrame, cutoffs=fv.PERCENTILE_CUTOFFS,
                probability_cutoffs=fv.PROBABILITY_CUTOFFS, overrides: dict | None = None,
                classifier_weight: float = fv.CLASSIFIER_WEIGHT) -> DataFrame:
    """Composite, 0-100 percentile score, and category.

    With a ``classifier_score`` column the category follows the probability
    (per-source cutoffs allowed); without one it follows the percentile.
    """
    heuristic = 0.7 * F.col("daily_max_score") + 0.3 * F.col("daily_mean_score")
    modelled = "classifier_score" in daily.columns
    staged = daily.withColumn("heuristic_raw_score", heuristic)
    raw = F.col("heuristic_raw_score")
    if modelled:
        staged = staged.withColumn("classifier_score", F.coalesce("classifier_score", F.lit(0.0)))
        raw = classifier_weight * F.col("classifier_score") + (1 - classifier_weight) * raw
    staged = staged.withColumn("raw_composite_score", raw)
    ranked = percentile_rank(staged, "raw_composite_score", "_percentile")
    if modelled:
        mode = "classifier+heuristic"
        label = category_by_source("classifier_score", "_source", overrides, probability_cutoffs)
    else:
        mode, label = "heuristic_only", category("_percentile", cutoffs)
    return ranked.select(
        *staged.columns, F.lit(mode).alias("scoring_mode"),
        F.bround("_percentile", 1).alias("risk_score"), label.alias("risk_category"))


def top_user_days(scored: DataFrame, k: int = 10) -> DataFrame:
    """L1: the k riskiest user-days."""
    return scored.orderBy(F.desc("raw_composite_score"), *DAY).limit(k)
