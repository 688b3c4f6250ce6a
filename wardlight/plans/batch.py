"""Raw events to alerts in one batch run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from wardlight import fixed_values as fv
from wardlight.operators.alerts import day_alerts
from wardlight.operators.baselines import blended_profiles, moments, score_events, source_stats, user_baselines
from wardlight.operators.features import daily_features, feature_columns, feature_matrix
from wardlight.operators.models import score_days
from wardlight.operators.quality import good_rows, keep_first, normalize, quarantine_rows
from wardlight.operators.risk import attach_model_scores, daily_risk_inputs, risk_scores
from wardlight.operators.tiers import attach_remediation, with_action_tier
from wardlight.session import materialize


@dataclass(frozen=True)
class BatchResult:
    """Frames of one run; events, baselines and risk are stored, the rest is lazy."""

    events: DataFrame
    quarantine: DataFrame
    risk: DataFrame
    alerts: DataFrame


def stored_profiles(spark: SparkSession, matrix: DataFrame) -> DataFrame:
    """Blended profiles; the small merged moments are written, so the matrix is read once for them."""
    mom = materialize(spark, moments(matrix), "moments")
    return blended_profiles(user_baselines(mom), source_stats(mom), feature_columns(matrix))


def event_scores(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Normalized events to scored feature rows."""
    matrix = feature_matrix(events)
    return score_events(matrix, stored_profiles(spark, matrix))


def run(spark: SparkSession, events: DataFrame, remediation: DataFrame, model: PipelineModel | None = None,
        casb_source: str = fv.CASB_SOURCE, overrides: dict | None = None, order: str = "input_ord") -> BatchResult:
    """Normalize, score, rank, advise and export.

    Three tables are written on the way (events, moments, risk); each cuts the
    lineage where more than one reader follows.
    """
    checked = materialize(spark, normalize(keep_first(events, order)), "events")
    clean = good_rows(checked)
    scored = event_scores(spark, clean)
    daily = daily_risk_inputs(scored)
    if model is not None:
        daily = attach_model_scores(daily, score_days(model, daily_features(feature_matrix(clean))))
    advised = attach_remediation(daily, remediation, casb_source)
    risk = materialize(spark, with_action_tier(risk_scores(advised, overrides=overrides)), "risk")
    return BatchResult(clean, quarantine_rows(checked), risk, day_alerts(risk))
