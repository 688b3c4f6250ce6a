"""Scores, severities, categories and other small decision columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.text import col, lookup


def hour_distance(hour, centre) -> Column:
    """Hours apart on a 24-hour dial."""
    return F.abs(F.pmod(col(hour) - col(centre) + 12, F.lit(24)) - 12)


def z_score_points(z) -> Column:
    """A robust z as 0..100 points."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround((col(z) - 2) * 25))).cast("int")


def signal_severity(score) -> Column:
    """P28."""
    score = col(score)
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def _check_cutoffs(cutoffs):
    low, medium, high, critical = cutoffs
    if not low < medium < high < critical:
        raise ValueError(f"cutoffs must rise strictly: {cutoffs}")


def category(value, cutoffs=fv.PERCENTILE_CUTOFFS, labels=fv.RISK_CATEGORIES) -> Column:
    """Five ordered tiers from four strictly rising cutoffs."""
    _check_cutoffs(cutoffs)
    if len(labels) != 5:
        raise ValueError("exactly five labels are needed")
    value = col(value)
    low, medium, high, critical = cutoffs
    return (F.when(value >= critical, labels[4]).when(value >= high, labels[3])
            .when(value >= medium, labels[2]).when(value >= low, labels[1]).otherwise(labels[0]))


def category_by_source(value, source, overrides: dict | None = None,
                       cutoffs=fv.PROBABILITY_CUTOFFS) -> Column:
    """Per-source cutoffs; a cutoff that is not overridden stays global."""
    result = category(value, cutoffs)
    names = ("low", "medium", "high", "critical")
    for name, override in (overrides or {}).items():
        own = tuple(override.get(n, c) for n, c in zip(names, cutoffs))
        result = F.when(col(source) == name, category(value, own)).otherwise(result)
    return result


def category_rank(c) -> Column:
    """Order of the risk categories, 0 to 4."""
    return lookup({name: i for i, name in enumerate(fv.RISK_CATEGORIES)}, col(c))


def baseline_confidence(sample_days) -> Column:
    """0 without history, else 0.4 rising to 1.0 at seven days."""
    d = col(sample_days)
    ramp = F.bround(F.least(F.lit(1.0), 0.4 + 0.6 * F.least(d, F.lit(7)) / 7), 2)
    return F.when(d > 0, ramp).otherwise(0.0)


def event_severity(score) -> Column:
    """Severity of an orchestrated score."""
    score = col(score)
    return (F.when(score >= 90, "critical").when(score >= 70, "high")
            .when(score >= 40, "medium").otherwise("low"))


def event_tier(score, severity) -> Column:
    """Tier by severity, R1 when nothing fired."""
    return F.when(col(score) > 0, lookup(fv.ORCHESTRATED_TIER, col(severity))).otherwise("R1")


def event_recommendation(severity, explanation, confidence) -> Column:
    """Sentence naming the strongest signal; notes a short history."""
    confidence = col(confidence)
    percent = F.bround(confidence * 100).cast("int").cast("string")
    note = F.when(confidence < 0.9, F.concat(
        F.lit(fv.SHORT_HISTORY_TEXT[0]), percent, F.lit(fv.SHORT_HISTORY_TEXT[1]))).otherwise("")
    return F.when(col(explanation).isNull(), fv.NO_SIGNAL_TEXT).otherwise(
        F.concat(lookup(fv.ORCHESTRATED_ACTION, col(severity)), F.lit(" "), col(explanation), note))


def technique_tag(category_col, signal_col) -> Column:
    """By category, else by signal, else the default."""
    return F.coalesce(lookup(fv.CATEGORY_TECHNIQUE, col(category_col)),
                      lookup(fv.SIGNAL_TECHNIQUE, col(signal_col)), F.lit(fv.DEFAULT_TECHNIQUE))


def technique_note(reported, assigned) -> Column:
    """Remark when the reported tag differs from the assigned one."""
    reported, assigned = col(reported), col(assigned)
    return F.when((reported != "") & (reported != assigned), F.concat(
        F.lit(fv.TECHNIQUE_NOTE_TEXT[0]), reported, F.lit(fv.TECHNIQUE_NOTE_TEXT[1]), assigned))


def cert_signal(removable, external, exfil) -> Column:
    """Removable media, then external recipient, then exfiltration domain."""
    return (F.when(col(removable) == 1, "is_removable_media")
            .when(col(external) == 1, "external_recipient")
            .when(col(exfil) == 1, "is_exfil_domain"))


def heartbeat_state(status, polled_at, last_event_at, previous_event_at, now) -> Column:
    """Down when stale or failing, live when a newer event came, else idle."""
    age = F.unix_micros(col(now)) - F.unix_micros(col(polled_at))
    down = (col(polled_at).isNull() | (age > fv.HEARTBEAT_STALE_SECONDS * 1_000_000)
            | (col(status) == "error"))
    newer = col(last_event_at).isNotNull() & ~col(last_event_at).eqNullSafe(col(previous_event_at))
    return F.when(down, "down").when(newer, "live").otherwise("healthy-idle")


def standing_action(category_col) -> Column:
    """Action label for a trend category."""
    return F.coalesce(lookup(fv.STANDING_ACTION, col(category_col)), F.lit(fv.DEFAULT_STANDING_ACTION))


def login_or_activity(description) -> Column:
    """A network event is a login when its rule text says so."""
    text = F.lower(F.coalesce(col(description), F.lit("")))
    return F.when(text.rlike("|".join(fv.LOGIN_KEYWORDS)), "login").otherwise("activity")


def security_kind(event_type, description) -> Column:
    """Login, activity or transfer."""
    return F.when(col(event_type) == "network_access", login_or_activity(description)).otherwise(
        F.coalesce(lookup(fv.SECURITY_KIND, col(event_type)), F.lit("activity")))


def live_indicator(event_type, description) -> Column:
    """P25: feature column of a live event; NULL when it has none."""
    by_text = F.when(login_or_activity(description) == "login", "et_login_event").otherwise(
        "et_browser_activity")
    return F.when(col(event_type) == "network_access", by_text).otherwise(
        lookup(fv.LIVE_INDICATOR, col(event_type)))


def siem_event_kind(groups, full_log) -> Column:
    """Ordered tests on rule groups and log text."""
    groups = F.coalesce(col(groups), F.array().cast("array<string>"))
    log = F.lower(F.coalesce(col(full_log), F.lit("")))

    def has(*names):
        return F.arrays_overlap(groups, F.array(*[F.lit(n) for n in names]))

    return (F.when(has("syscheck"), "file_integrity")
            .when(has("file", "usb"), "file_upload")
            .when(has("software") | F.contains(log, F.lit("installed"))
                  | F.contains(log, F.lit("package")), "installed_application")
            .when(has("dlp", "data_loss"), "dlp_outcome")
            .otherwise("network_access"))


def casb_risk_reasons(raw) -> Column:
    """P10: reasons from eight tests on a CASB row (``raw`` gives a column by name)."""
    from wardlight.functions.text import clean_marker

    category_col = clean_marker(raw("shadow_it_category"))
    data_class = clean_marker(raw("data_classification"))
    scope = clean_marker(raw("oauth_scope_granted"))
    return F.array_compact(F.array(
        F.when(raw("is_off_hours").cast("double") == 1, "off_hours_activity"),
        F.when(raw("device_managed").cast("double") == 0, "unmanaged_device"),
        F.concat(F.lit("shadow_it:"), category_col),
        F.when(raw("sanction_status") == "Unsanctioned", "unsanctioned_application"),
        # "none" is a real auth method here, the weakest one.
        F.when(raw("auth_method").isin(*fv.WEAK_AUTH_METHODS), "weak_auth_method"),
        F.when(data_class.isin("Restricted-PII", "Restricted-Financial"),
               F.concat(F.lit("sensitive_data:"), data_class)),
        F.when(scope.contains("full_access") | scope.contains("admin"), "broad_oauth_scope"),
        F.when(raw("policy_violation").cast("double") == 1, "policy_violation"),
    ))
