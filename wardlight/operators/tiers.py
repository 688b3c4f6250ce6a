"""Action tiers and remediation advice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.text import lookup

OPTIONAL = {"repeat_count": ("int", 1), "peer_prevalence": ("double", 0.0),
            "self_audit_response": ("string", None), "is_known_bad_category": ("boolean", False)}


def _percent(c):
    return F.concat(F.bround(c * 100).cast("int").cast("string"), F.lit("%"))


def filled(pieces, *values):
    """Fixed text pieces with values between them."""
    parts = []
    for i, piece in enumerate(pieces):
        parts.append(F.lit(piece))
        if i < len(values):
            parts.append(values[i])
    return F.concat(*parts)


def base_tier_reason(base: str = "_base"):
    """Why the base tier is what it is."""
    return filled(fv.BASE_TIER_TEXT, F.col("risk_category"), F.col(base), lookup(fv.TIER_LABEL, F.col(base)))


def input_errors():
    """What is wrong with the tier inputs of a row, NULL when nothing is."""
    return F.coalesce(
        F.when(~F.coalesce(F.col("risk_category").isin(*fv.RISK_CATEGORIES), F.lit(False)),
               "unknown risk_category"),
        F.when(~F.col("self_audit_response").isin(*fv.SELF_AUDIT_ANSWERS), "unknown self_audit_response"),
        F.when(~F.col("peer_prevalence").between(0.0, 1.0), "peer_prevalence out of range"),
        F.when(F.col("repeat_count") < 0, "negative repeat_count"))


def with_action_tier(scored: DataFrame, repeat_threshold: int = fv.REPEAT_THRESHOLD,
                     prevalence_threshold: float = fv.PEER_PREVALENCE_THRESHOLD,
                     on_error: str = "raise") -> DataFrame:
    """r_tier, r_tier_label, r_tier_reasons and r_tier_explanation.

    Columns of ``OPTIONAL`` are used where present, their defaults elsewhere.
    Invalid rows raise, or get an ``r_tier_error`` when ``on_error='mark'``.
    """
    df = scored
    for name, (kind, default) in OPTIONAL.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    base = lookup(fv.BASE_TIER, F.col("risk_category"))
    df = df.withColumn("_error", input_errors()).withColumn("_base", base)
    if on_error == "raise":
        df = df.withColumn("_base", F.when(F.col("_error").isNotNull(), F.raise_error(F.col("_error")))
                           .otherwise(F.col("_base")))
    alert = F.col("risk_category") != "Informational"
    denied = F.coalesce(F.col("self_audit_response") == "denied", F.lit(False))
    common = alert & (F.col("peer_prevalence") >= prevalence_threshold) & (F.col("_base") != "R6")
    repeated = alert & (F.col("repeat_count") >= repeat_threshold)
    df = df.withColumn("_step", F.when(common, "R4")
                       .when(repeated, lookup(fv.TIER_ABOVE, F.col("_base"))).otherwise(F.col("_base")))
    floored = F.coalesce(F.col("is_known_bad_category"), F.lit(False)) & F.col("_step").isin(
        *fv.FLOOR_RAISED_TIERS)
    tier = F.when(denied, "R6").when(floored, "R5").otherwise(F.col("_step"))
    reasons = F.when(denied, F.array(F.lit(fv.DENIED_TEXT))).otherwise(F.array_compact(F.array(
        base_tier_reason(),
        F.when(common, filled(fv.PREVALENCE_LEAD, _percent(F.col("peer_prevalence")),
                              _percent(F.lit(prevalence_threshold)), F.lit(fv.PREVALENCE_TEXT)))
        .when(repeated, filled(fv.REPEAT_TEXT, F.col("repeat_count").cast("string"),
                               F.lit(str(repeat_threshold)), F.col("_base"), F.col("_step"))),
        F.when(floored, filled(fv.FLOOR_TEXT, F.col("_step"))))))
    df = df.withColumn("r_tier", tier).withColumn("r_tier_reasons", reasons)
    df = (df.withColumn("r_tier_label", lookup(fv.TIER_LABEL, F.col("r_tier")))
          .withColumn("r_tier_explanation", F.array_join("r_tier_reasons", " ")))
    if on_error == "mark":
        df = df.withColumn("r_tier_error", F.col("_error"))
    return df.drop("_base", "_step", "_error")


def section_fixes(remediation: DataFrame, max_fixes: int = 2) -> DataFrame:
    """Per section its title and its first fixes in number order.

    A section repeats fix numbers per topic, so the order is topic, then number
    (``ord``). Only the first fixes of each section are collected.
    """
    from pyspark.sql import Window

    first = Window.partitionBy("section_id").orderBy("ord")
    top = remediation.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_fixes)
    fixes = F.sort_array(F.collect_list(F.when(
        F.col("fix_title").isNotNull(), F.struct("ord", "fix_title", "evidence_tier"))))
    return top.groupBy("section_id", "section_title").agg(fixes.alias("_f")).select(
        "section_id", "section_title", F.transform("_f", lambda x: F.struct(
            x["fix_title"].alias("title"), x["evidence_tier"].alias("evidence_tier"))).alias("fixes"))


def attach_remediation(daily: DataFrame, remediation: DataFrame, casb_source: str = fv.CASB_SOURCE,
                       max_fixes: int = 2) -> DataFrame:
    """Section and first fixes by category (CASB) or signal, with a status."""
    category, sign = F.col("shadow_it_category"), F.col("cert_signal")
    by_category = (F.col("_source") == casb_source) & category.isNotNull()
    section = (F.when(by_category, lookup(fv.CATEGORY_SECTION, category))
               .otherwise(lookup(fv.SIGNAL_SECTION, sign)))
    sections = section_fixes(remediation, max_fixes)
    joined = daily.withColumn("section_id", section).join(sections, "section_id", "left")
    status = (F.when(by_category & F.col("section_id").isNull(), "unknown_category")
              .when(~by_category & sign.isNull(), "no_signal")
              .when(F.col("section_id").isNull(), "no_match")
              .when(F.col("section_title").isNull(), "section_not_found").otherwise("ok"))
    return joined.select(*daily.columns, status.alias("recommendation_status"),
                         F.col("section_title").alias("recommended_section"),
                         F.col("fixes").alias("recommended_fixes"))
