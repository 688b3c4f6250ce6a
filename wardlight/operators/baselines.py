"""Mean/deviation baselines per user and source, and event scores against them.

The wide column lists are written as SQL expressions: one short text per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.operators.features import feature_columns

_MOMENT_KEYS = ("_username", "_source")


# Features that are 0 or 1 everywhere: the sum is also the sum of squares.
_ZERO_ONE = tuple(f"et_{t}" for t in fv.INDICATOR_EVENT_TYPES) + (
    "is_weekend", "is_off_hours", "has_domain", "is_exfil_domain", "has_file", "is_removable_media",
    "weak_auth", "risky_network_zone", "is_shadow_it", "sanction_unsanctioned", "external_recipient")


def moments(matrix: DataFrame) -> DataFrame:
    """Mergeable statistics of normal rows per (user, source): count, sums, sums of squares.

    Both baselines merge these small rows, so writing them once (see
    ``session.materialize``) makes one read of the matrix serve the two. One
    fixed-width number per aggregate keeps the hash aggregate and its code small.
    """
    features = feature_columns(matrix)
    normal = matrix.selectExpr(*_MOMENT_KEYS, "unix_micros(ts) AS _us", "_label", "1 - _label AS _w", *features)
    aggregates = ["count(1) AS n_rows", "sum(_label) AS n_labeled", "min(_us) AS first_us"]
    for f in features:
        aggregates.append(f"sum({f} * _w) AS s_{f}")
        if f not in _ZERO_ONE:
            aggregates.append(f"sum({f} * {f} * _w) AS q_{f}")
    grouped = normal.groupBy(*_MOMENT_KEYS).agg(*map(F.expr, aggregates))
    return grouped.withColumn("n", F.col("n_rows") - F.col("n_labeled"))


def _features_of(mom: DataFrame) -> list[str]:
    return [c[2:] for c in mom.columns if c.startswith("s_")]


def _merged(features: list[str]):
    """Aggregates that merge the sums of each feature."""
    return [F.sum(f"s_{f}").cast("double").alias(f"s1_{f}") for f in features] + [
        F.sum(f"q_{f}").cast("double").alias(f"s2_{f}") for f in features if f not in _ZERO_ONE]


def _mean(f: str, n: str) -> str:
    return f"s1_{f} / nullif({n}, 0)"


def _std(f: str, n: str) -> str:
    """Sample deviation from merged sums.

    A spread below a millionth of a millionth of the squares is rounding of
    equal values and counts as 0.
    """
    squares = f"s1_{f}" if f in _ZERO_ONE else f"s2_{f}"
    spread = f"({squares} - s1_{f} * s1_{f} / {n})"
    return (f"CASE WHEN {n} > 1 THEN CASE WHEN {spread} <= {squares} * 1e-12D THEN 0D "
            f"ELSE sqrt({spread} / ({n} - 1)) END END")


def user_baselines(mom: DataFrame) -> DataFrame:
    """Per user, mean and deviation of normal rows only, from moments.

    Users without a normal row stay, with NULL means, zero deviation and
    event_count 0. ``sources`` lists the sources of the user (a handful).
    """
    features = _features_of(mom)
    grouped = mom.groupBy(F.col("_username").alias("username")).agg(
        F.min_by("_source", "first_us").alias("source"), F.collect_set("_source").alias("sources"),
        F.sum("n_labeled").alias("labeled_anomaly_count"), F.sum("n").alias("event_count"),
        *_merged(features))
    stats = []
    for f in features:
        if f.startswith("et_"):
            stats.append(f"{_mean(f, 'event_count')} AS {f}_share")
        else:
            stats += [f"{_mean(f, 'event_count')} AS {f}_mean",
                      f"coalesce({_std(f, 'event_count')}, 0D) AS {f}_std"]
    return grouped.selectExpr("username", "source", "sources", "labeled_anomaly_count",
                              "event_count", *stats)


def source_stats(mom: DataFrame) -> DataFrame:
    """A2: per source, statistics of normal rows, totals, users and anomaly rate.

    Users are counted from the (user, source) rows, without a distinct step.
    """
    features = _features_of(mom)
    grouped = mom.groupBy(F.col("_source").alias("source")).agg(
        F.sum("n_rows").alias("n_total_events"), F.sum("n").alias("n_normal_events"),
        F.count_if(F.col("n") > 0).alias("n_users"), F.sum("n_labeled").alias("_bad"), *_merged(features))
    stats = []
    for f in features:
        stats += [f"{_mean(f, 'n_normal_events')} AS {f}_mean",
                  f"{_std(f, 'n_normal_events')} AS {f}_std"]
    return grouped.selectExpr("source", "n_total_events", "n_normal_events", "n_users",
                              "_bad / n_total_events AS anomaly_rate", *stats)


def zero_variance_columns(stats: DataFrame) -> DataFrame:
    """A2: (source, feature) pairs whose deviation is zero."""
    names = [c[:-4] for c in stats.columns if c.endswith("_std")]
    flags = ", ".join(f"CASE WHEN {n}_std = 0 THEN '{n}' END" for n in names)
    return stats.selectExpr("source", f"explode(array_compact(array({flags}))) AS feature")


def blended_profiles(users: DataFrame, stats: DataFrame, features: list[str],
                     shrinkage_k: float = fv.SHRINKAGE_K) -> DataFrame:
    """Own and source statistics blended by w = n/(n+k), per (user, source).

    Blending runs on one row per user instead of one per event. A feature whose
    source mean is the sentinel gets a NULL mean: it does not apply there.
    """
    continuous = [f for f in features if f in fv.CONTINUOUS_FEATURES]
    own = users.selectExpr(
        "username AS _username", "explode(sources) AS _source",
        f"event_count / (event_count + {float(shrinkage_k)}D) AS _w",
        *[f"{f}_share AS u_{f}" if f.startswith("et_") else f"{f}_mean AS u_{f}" for f in features],
        *[f"{f}_std AS us_{f}" for f in continuous])
    peers = stats.selectExpr("source AS _source", *[f"{f}_mean AS p_{f}" for f in features],
                             *[f"{f}_std AS ps_{f}" for f in continuous])

    def blend(mine, theirs):
        return f"(_w * coalesce({mine}, {theirs}) + (1 - _w) * {theirs})"

    return own.join(peers, "_source", "left").selectExpr(
        *_MOMENT_KEYS,
        *[f"CASE WHEN p_{f} <> {fv.SENTINEL} THEN {blend(f'u_{f}', f'p_{f}')} END AS m_{f}"
          for f in features],
        *[f"{blend(f'us_{f}', f'ps_{f}')} AS s_{f}" for f in continuous])


# Features that never hold the sentinel; any other one is tested for it.
_SENTINEL_FREE = fv.CONTINUOUS_FEATURES + _ZERO_ONE


def deviation(feature: str) -> str:
    """M2: distance of a feature from its blended baseline, 0..1 or NULL."""
    gap = f"abs({feature} - m_{feature})"
    if feature in fv.CONTINUOUS_FEATURES:
        std, tiny, clip = f"s_{feature}", f"{fv.ZERO_VARIANCE}D", f"{fv.Z_CLIP}D"
        body = (f"CASE WHEN {std} < {tiny} THEN CAST({gap} >= {tiny} AS DOUBLE) "
                f"ELSE {gap} / greatest({std} * {clip}, {gap} + 0D * {std}) END")
    else:
        body = f"least({gap}, 1D + 0D * m_{feature})"
    if feature in _SENTINEL_FREE:
        return body
    return f"CASE WHEN {feature} <> {fv.SENTINEL} THEN {body} END"


def with_deviations(matrix: DataFrame, profiles: DataFrame, features: list[str]) -> DataFrame:
    """M2: matrix with one ``d_<feature>`` column per feature."""
    joined = matrix.join(profiles, list(_MOMENT_KEYS), "left")
    return joined.selectExpr(*matrix.columns, *[f"{deviation(f)} AS d_{f}" for f in features])


_CODE_SCALE = 10 ** 15


def deviation_codes(features: list[str]) -> str:
    """SQL: one number per feature, larger for a larger deviation, then for an earlier column.

    Fifteen digits of the deviation and the column number fit one BIGINT, so
    ranking needs no structs. A feature that does not apply gives 0.
    """
    n = len(features)
    parts = (f"CAST(coalesce(d_{f}, 0D) * {_CODE_SCALE}D AS BIGINT) * 100 + {n - i}" for i, f in enumerate(features))
    return f"array({', '.join(parts)})"


def contributors_of(codes: str, features: list[str], k: int = 5):
    """The k largest deviations above zero of a codes column; ties keep the column order."""
    n = len(features)
    names = ", ".join(f"'{f}'" for f in features)
    return F.expr(
        f"transform(filter(slice(sort_array({codes}, false), 1, {k}), x -> x >= 100), x -> named_struct("
        f"'feature', element_at(array({names}), CAST({n} - x % 100 + 1 AS INT)), "
        f"'deviation', bround((x DIV 100) / {_CODE_SCALE}D, 3)))")


def render_contributors(contributors: str):
    """``feature=value; ...`` text of a contributor array."""
    return F.expr(f"array_join(transform({contributors}, "
                  "x -> concat(x.feature, '=', CAST(x.deviation AS STRING))), '; ')")


def score_events(matrix: DataFrame, profiles: DataFrame) -> DataFrame:
    """M3: mean of the deviations that apply (0 if none) and the deviation codes.

    The codes are ranked (``contributors_of``) where a row is shown or chosen,
    not for every event.
    """
    features = feature_columns(matrix)
    devs = with_deviations(matrix, profiles, features)
    total = " + ".join(f"coalesce(d_{f}, 0D)" for f in features)
    used = " + ".join(f"CAST(d_{f} IS NOT NULL AS INT)" for f in features)
    return devs.selectExpr(
        *matrix.columns, f"coalesce(({total}) / nullif({used}, 0), 0D) AS anomaly_score",
        f"{deviation_codes(features)} AS deviation_codes")
