"""Features, baselines, scores and user-day risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from verification import sql as S
from verification.binding import flat_events, unified_events
from verification.registry import query
from wardlight import fixed_values as fv
from wardlight.functions.rules import category, category_by_source
from wardlight.operators import baselines as B
from wardlight.operators import features as FE
from wardlight.operators import ranking as R
from wardlight.operators import risk as K
from wardlight.plans import batch
from wardlight.session import materialize


def matrix(spark, sf):
    return FE.feature_matrix(unified_events(spark, sf))


def profiles(spark, m):
    return batch.stored_profiles(spark, m)


def scored(spark, sf):
    m = matrix(spark, sf)
    return B.score_events(m, profiles(spark, m))


def daily(spark, sf):
    return K.daily_risk_inputs(scored(spark, sf))


def risk(spark, sf):
    return K.risk_scores(daily(spark, sf))


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def day(name="date"):
    return F.col(name).cast("string").alias(name)


_LOGS = ("bytes_sent_log", "bytes_received_log", "file_size_log")
_INT = [f for f in S.FEATURES if f not in _LOGS]


def flagship(spark, sf):
    return K.top_user_days(risk(spark, sf)).select(
        "_username", "_source", day(), *r6("raw_composite_score"), "risk_score", "risk_category",
        "driver_event_id", "top_contributors")


@query("p15_feature_matrix", S.MATRIX + f"SELECT event_id, {', '.join(_INT)}, {S.r6(*_LOGS)}, "
       "_label, _source, _username FROM fm")
def p15(spark, sf):
    return matrix(spark, sf).select("event_id", *_INT, *r6(*_LOGS), "_label", "_source", "_username")


_ub_cols = ", ".join(
    [f"round(u_{f}, 6) AS {f}_share" for f in S.FEATURES if f.startswith("et_")]
    + [f"round(u_{f}, 6) AS {f}_mean, round(us_{f}, 6) AS {f}_std" for f in S.FEATURES
       if not f.startswith("et_")])


@query("a1_user_baselines", S.BASE + "SELECT username, source, labeled_anomaly_count, event_count, "
       f"{_ub_cols} FROM ub")
def a1(spark, sf):
    b = B.user_baselines(B.moments(matrix(spark, sf)))
    stats = [c for c in b.columns if c.endswith(("_mean", "_std", "_share"))]
    return b.select("username", "source", "labeled_anomaly_count", "event_count", *r6(*stats))


@query("a2_source_stats", S.BASE + "SELECT source, n_total_events, n_normal_events, n_users, "
       "round(anomaly_rate, 6) AS anomaly_rate, "
       + ", ".join(f"round(p_{f}, 6) AS {f}_mean, round(ps_{f}, 6) AS {f}_std" for f in S.FEATURES)
       + " FROM ss")
def a2(spark, sf):
    s = B.source_stats(B.moments(matrix(spark, sf)))
    stats = [c for c in s.columns if c.endswith(("_mean", "_std"))]
    return s.select("source", "n_total_events", "n_normal_events", "n_users",
                    *r6("anomaly_rate", *stats))


@query("a2_zero_variance", S.BASE + "SELECT source, feature FROM ("
       + " UNION ALL ".join(f"SELECT source, '{f}' AS feature, ps_{f} AS s FROM ss" for f in S.FEATURES)
       + ") WHERE s = 0")
def a2z(spark, sf):
    return B.zero_variance_columns(B.source_stats(B.moments(matrix(spark, sf))))


_d = [f"et_{t}" for t in fv.INDICATOR_EVENT_TYPES]


@query("a3_daily_features", S.MATRIX + "SELECT _username, _source, CAST(d AS VARCHAR) AS date, "
       + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in (*_d, *fv.DAILY_SUM_FEATURES)) + ", "
       + ", ".join(f"round(max({c}), 6) AS {c}" for c in fv.DAILY_MAX_FEATURES) + ", "
       + ", ".join(f"round(avg({c}), 6) AS {c}" for c in fv.DAILY_MEAN_FEATURES) + ", "
       + ", ".join(f"round(sum({c}) / count(*), 6) AS {c}_share" for c in _d)
       + ", count(*) AS daily_event_count, max(_label) AS _label FROM fm GROUP BY ALL")
def a3(spark, sf):
    f = FE.daily_features(matrix(spark, sf))
    shares = [f"{c}_share" for c in _d]
    return f.select("_username", "_source", day(), *_d, *fv.DAILY_SUM_FEATURES,
                    *r6(*fv.DAILY_MAX_FEATURES, *fv.DAILY_MEAN_FEATURES, *shares),
                    "daily_event_count", "_label")


@query("m1_blended_profiles", S.BASE + "SELECT DISTINCT fm._username, fm._source, "
       + ", ".join(f"round(CASE WHEN p_{f} <> -1 THEN {S._blend(f'u_{f}', f'p_{f}')} END, 6) AS m_{f}"
                   for f in S.FEATURES) + ", "
       + ", ".join(f"round({S._blend(f'us_{f}', f'ps_{f}')}, 6) AS s_{f}" for f in fv.CONTINUOUS_FEATURES)
       + " FROM fm JOIN ub ON fm._username = ub.username JOIN ss ON fm._source = ss.source")
def m1(spark, sf):
    m = matrix(spark, sf)
    p = profiles(spark, m)
    return p.select("_username", "_source", *r6(*[c for c in p.columns if c[:2] in ("m_", "s_")]))


@query("m2_deviations", S.ctes(S.EV, S.FM, S.UB, S.SS, S.DEV) + "SELECT event_id, "
       + ", ".join(f"round(d_{f}, 6) AS d_{f}" for f in S.FEATURES) + " FROM dev")
def m2(spark, sf):
    m = matrix(spark, sf)
    features = FE.feature_columns(m)
    p = profiles(spark, m)
    return B.with_deviations(m, p, features).select("event_id", *r6(*[f"d_{f}" for f in features]))


@query("m3_event_scores", S.SCORES + f"SELECT event_id, _username, _source, _label, "
       f"{S.r6('anomaly_score')} FROM sc")
def m3(spark, sf):
    return scored(spark, sf).select("event_id", "_username", "_source", "_label", *r6("anomaly_score"))


@query("w2_top_contributors", S.ctes(S.EV, S.FM, S.UB, S.SS, S.DEV) + ", l AS ("
       + " UNION ALL ".join(f"SELECT event_id, '{f}' AS feature, {i} AS ord, d_{f} AS v FROM dev WHERE d_{f} > 0"
                            for i, f in enumerate(S.FEATURES))
       + "), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(v, 9) DESC, ord) AS rn FROM l) "
         "SELECT event_id, CAST(rn AS INT) AS rn, feature, round_even(v, 3) AS deviation FROM r WHERE rn <= 5")
def w2(spark, sf):
    m = matrix(spark, sf)
    features = FE.feature_columns(m)
    p = profiles(spark, m)
    devs = B.with_deviations(m, p, features)
    # Values equal but for the last bits count as ties, as in the SQL.
    even = devs.select("event_id", *[F.round(f"d_{f}", 9).alias(f"d_{f}") for f in features])
    coded = even.select("event_id", F.expr(B.deviation_codes(features)).alias("codes"))
    return (coded.select("event_id", F.posexplode(B.contributors_of("codes", features)).alias("pos", "c"))
            .select("event_id", (F.col("pos") + 1).alias("rn"), F.col("c.feature").alias("feature"),
                    F.col("c.deviation").alias("deviation")))


@query("j3_scores_vs_baselines", S.ctes(S.EV, S.FM, S.UB, S.SS) +
       "SELECT fm.event_id, event_count, round(u_hour, 6) AS hour_user, round(p_hour, 6) AS hour_source "
       "FROM fm LEFT JOIN ub ON fm._username = ub.username LEFT JOIN ss ON fm._source = ss.source")
def j3(spark, sf):
    m = matrix(spark, sf)
    mom = materialize(spark, B.moments(m), "moments")
    users, stats = B.user_baselines(mom), B.source_stats(mom)
    return (m.select("event_id", "_username", "_source")
            .join(users.select(F.col("username").alias("_username"), "event_count",
                               F.round("hour_mean", 6).alias("hour_user")), "_username", "left")
            .join(stats.select(F.col("source").alias("_source"),
                               F.round("hour_mean", 6).alias("hour_source")), "_source", "left")
            .select("event_id", "event_count", "hour_user", "hour_source"))


@query("j2_recover_timestamps", S.MATRIX +
       "SELECT event_id, epoch_us(ts) AS ts_us, CAST(d AS VARCHAR) AS date FROM fm")
def j2(spark, sf):
    events = unified_events(spark, sf)
    stored = FE.feature_matrix(events).drop("ts")
    return FE.attach_timestamps(stored, events).select(
        "event_id", F.unix_micros("ts").alias("ts_us"), F.to_date("ts").cast("string").alias("date"))


@query("a5_daily_scores", S.RISK + "SELECT _username, _source, CAST(date AS VARCHAR) AS date, "
       f"{S.r6('daily_max_score', 'daily_mean_score')}, daily_event_count, daily_labeled_anomaly_count FROM dy")
def a5(spark, sf):
    return daily(spark, sf).select("_username", "_source", day(),
                                   *r6("daily_max_score", "daily_mean_score"), "daily_event_count",
                                   "daily_labeled_anomaly_count")


@query("a6_driver_event", S.RISK + "SELECT _username, _source, CAST(date AS VARCHAR) AS date, "
       "driver_event_id, shadow_it_category, cert_signal FROM dr")
def a6(spark, sf):
    return daily(spark, sf).select("_username", "_source", day(), "driver_event_id",
                                   "shadow_it_category", "cert_signal")


@query("w1_percentile_rank", S.RISK + "SELECT _username, _source, CAST(date AS VARCHAR) AS date, "
       "round(pct, 6) AS percentile FROM rs")
def w1(spark, sf):
    d = daily(spark, sf).withColumn("raw", 0.7 * F.col("daily_max_score") + 0.3 * F.col("daily_mean_score"))
    return R.percentile_rank(d, "raw").select("_username", "_source", day(), *r6("percentile"))


@query("m12_risk_scores", S.RISK + "SELECT _username, _source, CAST(date AS VARCHAR) AS date, "
       "round(raw_composite_score, 6) AS raw_composite_score, round_even(pct, 1) AS risk_score, risk_category FROM rs")
def m12(spark, sf):
    return risk(spark, sf).select("_username", "_source", day(), *r6("raw_composite_score"),
                                  "risk_score", "risk_category")


@query("l1_top_user_days", S.RISK + "SELECT _username, _source, CAST(date AS VARCHAR) AS date, "
       "round(raw_composite_score, 6) AS raw_composite_score, risk_category FROM rs "
       "ORDER BY raw_composite_score DESC, _username, _source, date LIMIT 10")
def l1(spark, sf):
    return K.top_user_days(risk(spark, sf)).select(
        "_username", "_source", day(), *r6("raw_composite_score"), "risk_category")


@query("p29_categories", S.ctes(S.EV) + "SELECT event_id, CASE WHEN k >= 99 THEN 'Critical' WHEN k >= 97 THEN 'High' "
       "WHEN k >= 90 THEN 'Medium' WHEN k >= 70 THEN 'Low' ELSE 'Informational' END AS by_percentile, "
       "CASE WHEN k / 100.0 >= 0.9 THEN 'Critical' WHEN k / 100.0 >= 0.5 THEN 'High' WHEN k / 100.0 >= 0.1 THEN 'Medium' "
       "WHEN k / 100.0 >= 0.02 THEN 'Low' ELSE 'Informational' END AS by_probability FROM ev")
def p29(spark, sf):
    e = flat_events(spark, sf)
    return e.select("event_id", category("k").alias("by_percentile"),
                    category(F.col("k") / 100.0, fv.PROBABILITY_CUTOFFS).alias("by_probability"))


@query("p30_source_cutoffs", S.ctes(S.EV) + "SELECT event_id, CASE WHEN source = 'casb' THEN "
       "CASE WHEN k >= 90 THEN 'Critical' WHEN k >= 30 THEN 'High' WHEN k >= 10 THEN 'Medium' WHEN k >= 1 THEN 'Low' "
       "ELSE 'Informational' END ELSE CASE WHEN k >= 90 THEN 'Critical' WHEN k >= 50 THEN 'High' WHEN k >= 10 THEN "
       "'Medium' WHEN k >= 2 THEN 'Low' ELSE 'Informational' END END AS risk_category FROM ev")
def p30(spark, sf):
    label = category_by_source(F.col("k") / 100.0, "source", {"casb": {"low": 0.01, "high": 0.30}})
    return flat_events(spark, sf).select("event_id", label.alias("risk_category"))


@query("l3_sampled_matrix", S.MATRIX + "SELECT _source, _label, CASE WHEN _label = 1 THEN count(*) "
       "ELSE least(count(*), 500) END AS kept FROM fm GROUP BY _source, _label")
def l3(spark, sf):
    kept = FE.keep_anomalies_sample_normal(matrix(spark, sf), 500)
    return kept.groupBy("_source", "_label").agg(F.count(F.lit(1)).alias("kept"))


@query("u1_union_of_sources", S.MATRIX + "SELECT _source, count(*) AS n_events, CAST(sum(_label) AS BIGINT) AS "
       "n_anomalies FROM fm GROUP BY _source")
def u1(spark, sf):
    e = unified_events(spark, sf)
    parts = [FE.feature_matrix(e.where(F.col("source") == s)) for s in ("casb", "cert")]
    union = parts[0].unionByName(parts[1])
    return union.groupBy("_source").agg(F.count(F.lit(1)).alias("n_events"),
                                        F.sum("_label").alias("n_anomalies"))


@query("j4_users_without_normal_rows", S.MATRIX + "SELECT _username AS username, count(*) FILTER (WHERE _label = 0 AND hour < 12) AS event_count, "
       "round(coalesce(stddev_samp(hour) FILTER (WHERE _label = 0 AND hour < 12), 0), 6) AS hour_std FROM fm GROUP BY _username")
def j4(spark, sf):
    # Only morning rows count as normal here, so some users have few or none.
    m = matrix(spark, sf).withColumn("_label", F.when(F.col("hour") < 12, F.col("_label")).otherwise(1))
    return B.user_baselines(B.moments(m)).select("username", "event_count", *r6("hour_std"))


@query("j5_features_with_scores", S.SCORES + "SELECT fm.event_id, hour, domain_len, round(anomaly_score, 6) AS anomaly_score FROM fm LEFT JOIN sc USING (event_id)")
def j5(spark, sf):
    # One lineage: the scored rows still carry their features.
    return scored(spark, sf).select("event_id", "hour", "domain_len", *r6("anomaly_score"))


@query("j6_daily_with_driver", S.RISK + "SELECT _username, _source, CAST(date AS VARCHAR) AS date, daily_event_count, driver_event_id, "
       "round(daily_max_score, 6) AS daily_max_score FROM dr")
def j6(spark, sf):
    return daily(spark, sf).select("_username", "_source", day(), "daily_event_count", "driver_event_id", *r6("daily_max_score"))


@query("u2_anomalies_and_sample", S.MATRIX + "SELECT count(*) FILTER (WHERE _label = 1) AS anomalies, least(200, count(*) FILTER (WHERE _label = 0 AND _source = 'casb')) "
       "+ least(200, count(*) FILTER (WHERE _label = 0 AND _source = 'cert')) AS sampled, 0 AS repeated FROM fm")
def u2(spark, sf):
    kept = FE.keep_anomalies_sample_normal(matrix(spark, sf), 200)
    ids = kept.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max("_label").alias("l"))
    return ids.agg(F.count_if(F.col("l") == 1).alias("anomalies"), F.count_if(F.col("l") == 0).alias("sampled"),
                   F.count_if(F.col("n") > 1).alias("repeated"))
