"""Detection quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from verification import sql as S
from verification.binding import table, unified_events
from verification.core_queries import matrix, r6, risk, scored
from verification.registry import query
from wardlight import fixed_values as fv
from wardlight.operators import evaluation as E
from wardlight.operators import features as FE

_PRF = ("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r")
_OUT = "round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1"
_METRICS = ("precision", "recall", "f1")


def metrics():
    return r6(*_METRICS)


@query("e1_rank_auc", S.SCORES + ", r AS (SELECT _label, anomaly_score AS s, rank() OVER (ORDER BY anomaly_score) + (count(*) OVER (PARTITION BY anomaly_score) - 1) / 2.0 AS rk FROM sc) "
       "SELECT round((sum(rk) FILTER (WHERE _label = 1) - np * (np + 1) / 2.0) / (np * nn), 6) AS auc, np AS n_pos, nn AS n_neg, "
       "round(avg(s) FILTER (WHERE _label = 1), 6) AS mean_pos, round(avg(s) FILTER (WHERE _label = 0), 6) AS mean_neg "
       "FROM r, (SELECT count(*) FILTER (WHERE _label = 1) AS np, count(*) FILTER (WHERE _label = 0) AS nn FROM sc) GROUP BY np, nn")
def e1(spark, sf):
    return E.rank_auc(scored(spark, sf), "anomaly_score", "_label").select(
        *r6("auc"), "n_pos", "n_neg", *r6("mean_pos", "mean_neg"))


_CUTS = sorted({*fv.SWEEP_CUTOFFS, fv.SELECTED_CUTOFF})


@query("e2_cutoff_sweep", S.SCORES + f", c AS (SELECT CAST(unnest([{', '.join(map(str, _CUTS))}]) AS DOUBLE) AS cutoff), x AS (SELECT cutoff, _source, anomaly_score >= cutoff AS f, _label = 1 AS a FROM sc, c), "
       "g AS (SELECT cutoff, CASE WHEN grouping(_source) = 1 THEN '(all)' ELSE _source END AS _source, count(*) FILTER (WHERE f) AS flagged, count(*) FILTER (WHERE f AND a) AS tp, "
       "count(*) FILTER (WHERE f AND NOT a) AS fp, count(*) FILTER (WHERE NOT f AND a) AS fn FROM x GROUP BY GROUPING SETS ((cutoff), (cutoff, _source))), "
       f"m AS (SELECT *, {_PRF} FROM g) SELECT cutoff, _source, flagged, tp, fp, fn, {_OUT} FROM m")
def e2(spark, sf):
    s = E.cutoff_sweep(scored(spark, sf), "anomaly_score", "_label", _CUTS)
    return s.select("cutoff", "_source", "flagged", "tp", "fp", "fn", *metrics())


@query("e3_day_evaluation", S.RISK + ", x AS (SELECT _source, risk_category IN ('High', 'Critical') AS f, daily_labeled_anomaly_count > 0 AS a FROM rs), "
       "g AS (SELECT CASE WHEN grouping(_source) = 1 THEN '(all)' ELSE _source END AS _source, count(*) AS n_days, count(*) FILTER (WHERE a) AS n_bad, count(*) FILTER (WHERE f AND a) AS tp, "
       "count(*) FILTER (WHERE f AND NOT a) AS fp, count(*) FILTER (WHERE NOT f AND a) AS fn FROM x GROUP BY GROUPING SETS ((), (_source))), "
       f"m AS (SELECT *, {_PRF} FROM g) SELECT _source, n_days, n_bad, tp, fp, fn, {_OUT} FROM m")
def e3(spark, sf):
    return E.day_evaluation(risk(spark, sf)).select("_source", "n_days", "n_bad", "tp", "fp", "fn", *metrics())


DOCS = """pd AS (SELECT d.doc_id, d.source AS _source, d.lang AS model, l.quality AS label, least(1.0, d.n_chars / 4000.0) AS probability
FROM documents d JOIN labels l USING (doc_id))"""


def predictions(spark, sf):
    """A length rule as model, per language, with the real document labels."""
    d, lb = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(lb, "doc_id").select(
        "doc_id", F.col("source").alias("_source"), F.col("lang").alias("model"), F.col("quality").alias("label"),
        F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("probability")).withColumn(
        "prediction", (F.col("probability") >= 0.2).cast("int"))


_CAND = """v AS (SELECT round(probability, 6) AS v, row_number() OVER (ORDER BY round(probability, 6)) - 1 AS i, count(*) OVER () - 1 AS n,
  lead(round(probability, 6)) OVER (ORDER BY round(probability, 6)) AS nx FROM (SELECT DISTINCT round(probability, 6) AS probability FROM pd)),
cand AS (SELECT (v + nx) / 2 AS cutoff FROM v WHERE nx IS NOT NULL AND i % CASE WHEN n > 15 THEN n // 15 ELSE 1 END = 0)"""


@query("l7_observed_cutoffs", S.ctes(DOCS, _CAND) + "SELECT round(cutoff, 9) AS cutoff FROM cand")
def l7(spark, sf):
    return E.observed_cutoffs(predictions(spark, sf), "probability", keep=15).select(F.round("cutoff", 9).alias("cutoff"))


_SWEEP = ("x AS (SELECT cutoff, _source, probability >= cutoff AS f, label = 1 AS a FROM pd, cand), "
          "g AS (SELECT cutoff, CASE WHEN grouping(_source) = 1 THEN '(all)' ELSE _source END AS _source, count(*) FILTER (WHERE f) AS flagged, count(*) FILTER (WHERE f AND a) AS tp, "
          "count(*) FILTER (WHERE f AND NOT a) AS fp, count(*) FILTER (WHERE NOT f AND a) AS fn FROM x GROUP BY GROUPING SETS ((cutoff), (cutoff, _source))), "
          f"m AS (SELECT *, {_PRF} FROM g), sw AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM m)")


@query("e4_observed_sweep", S.ctes(DOCS, _CAND, _SWEEP) + "SELECT round(cutoff, 9) AS cutoff, _source, flagged, tp, fp, fn, round(f1, 6) AS f1 FROM sw")
def e4(spark, sf):
    s = E.observed_sweep(predictions(spark, sf), "probability", "label")
    return s.select(F.round("cutoff", 9).alias("cutoff"), "_source", "flagged", "tp", "fp", "fn", *r6("f1"))


_EVERY = """cand AS (SELECT (v + lead(v) OVER (ORDER BY v)) / 2 AS cutoff FROM (SELECT DISTINCT round(probability, 6) AS v FROM pd) QUALIFY cutoff IS NOT NULL)"""


@query("l7_all_observed_cutoffs", S.ctes(DOCS, _EVERY) + "SELECT round(cutoff, 9) AS cutoff FROM cand")
def l7_all(spark, sf):
    return E.observed_cutoffs(predictions(spark, sf), "probability").select(F.round("cutoff", 9).alias("cutoff"))


@query("e4_best_cutoffs", S.ctes(DOCS, _EVERY, _SWEEP) + "SELECT _source, round(arg_max(cutoff, row(f1, -cutoff)), 9) AS cutoff, round(max(f1), 6) AS f1 FROM sw "
       "WHERE f1 > 0 AND (_source = '(all)' OR tp + fn >= 3) GROUP BY _source")
def e4b(spark, sf):
    found = E.best_observed_cutoffs(predictions(spark, sf), "probability", "label")
    return found.select("_source", F.round("cutoff", 9).alias("cutoff"), *r6("f1"))


_REPORT = ("x AS (SELECT *, probability >= 0.2 AS f, label = 1 AS a FROM pd UNION ALL SELECT doc_id, '(all)', model, label, probability, probability >= 0.2, label = 1 FROM pd), "
           "rk AS (SELECT *, rank() OVER (PARTITION BY model, _source ORDER BY probability) + (count(*) OVER (PARTITION BY model, _source, probability) - 1) / 2.0 AS rk FROM x), "
           "g AS (SELECT model, _source AS scope, count(*) AS n, count(*) FILTER (WHERE a) AS n_bad, count(*) FILTER (WHERE f AND a) AS tp, count(*) FILTER (WHERE f AND NOT a) AS fp, "
           "count(*) FILTER (WHERE NOT f AND a) AS fn, count(*) FILTER (WHERE NOT a) AS nn, sum(rk) FILTER (WHERE a) AS sr FROM rk GROUP BY ALL), "
           f"m AS (SELECT *, {_PRF}, CASE WHEN n_bad > 0 AND nn > 0 THEN (sr - n_bad * (n_bad + 1) / 2.0) / (n_bad * nn) END AS auc0 FROM g), "
           "rep AS (SELECT model, scope, n, n_bad, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, "
           "round(auc0, 4) AS auc FROM m WHERE scope = '(all)' OR (n >= 5 AND n_bad > 0))")


@query("e5_model_report", S.ctes(DOCS, _REPORT) + "SELECT * FROM rep")
def e5(spark, sf):
    return E.model_report(predictions(spark, sf))


@query("e8_best_model", S.ctes(DOCS, _REPORT) + "SELECT max_by(model, row(auc, model)) AS model, max(auc) AS auc, max(auc) > 0.6159 AS beats_heuristic FROM rep WHERE scope = '(all)' AND auc IS NOT NULL")
def e8(spark, sf):
    return E.best_model(E.model_report(predictions(spark, sf)))


@query("w5_user_split", S.MATRIX + ", u AS (SELECT _source, _username, max(_label) AS has_anomaly FROM fm GROUP BY ALL) SELECT _source, has_anomaly, count(*) AS n_users, "
       "CASE WHEN count(*) > 1 THEN CAST(greatest(1, round_even(count(*) * 0.2, 0)) AS BIGINT) ELSE 0 END AS n_test FROM u GROUP BY ALL")
def w5(spark, sf):
    return E.split_users(matrix(spark, sf)).groupBy("_source", "has_anomaly").agg(
        F.count(F.lit(1)).alias("n_users"), F.count_if("is_test").alias("n_test"))


@query("u3_train_test", S.MATRIX + "SELECT count(*) AS n_rows, 0 AS shared_users FROM fm")
def u3(spark, sf):
    m = matrix(spark, sf)
    train, test = E.train_test(m, E.split_users(m))
    both = train.select("_username", F.lit(0).alias("t")).unionByName(test.select("_username", F.lit(1).alias("t")))
    users = both.groupBy("_username").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    return users.agg(F.sum("n").alias("n_rows"), F.count_if(F.col("lo") != F.col("hi")).alias("shared_users"))


_SPLIT = "u AS (SELECT DISTINCT _username, CAST(substr(_username, 6) AS INT) % 5 = 0 AS is_test FROM fm)"


def fixed_split(m):
    return m.select("_source", "_username").distinct().withColumn(
        "is_test", F.substring("_username", 6, 6).cast("int") % 5 == 0)


@query("e6_held_out_gap", S.RISK + f", {_SPLIT}, x AS (SELECT unnest(['all', CASE WHEN is_test THEN 'held_out' ELSE 'train' END]) AS part, risk_category IN ('High', 'Critical') AS f, "
       "daily_labeled_anomaly_count > 0 AS a FROM rs JOIN u USING (_username)), g AS (SELECT part, count(*) AS n_days, count(*) FILTER (WHERE f AND a) AS tp, "
       f"count(*) FILTER (WHERE f AND NOT a) AS fp, count(*) FILTER (WHERE NOT f AND a) AS fn FROM x GROUP BY part), m AS (SELECT *, {_PRF} FROM g) SELECT part, n_days, tp, fp, fn, {_OUT} FROM m")
def e6(spark, sf):
    return E.held_out_gap(risk(spark, sf), fixed_split(matrix(spark, sf))).select(
        "part", "n_days", "tp", "fp", "fn", *metrics())


@query("j11_held_out_days", S.RISK + f", {_SPLIT} SELECT is_test, count(*) AS n_days FROM rs JOIN u USING (_username) GROUP BY is_test")
def j11(spark, sf):
    train, test = E.train_test(FE.daily_features(matrix(spark, sf)), fixed_split(matrix(spark, sf)))
    return (train.agg(F.count(F.lit(1)).alias("n_days")).withColumn("is_test", F.lit(False))
            .unionByName(test.agg(F.count(F.lit(1)).alias("n_days")).withColumn("is_test", F.lit(True))))


_SCEN = ("sd AS (SELECT DISTINCT _username, d AS date, scenario_id, threat_scenario FROM fm WHERE scenario_id IS NOT NULL), "
         "sj AS (SELECT rs.*, scenario_id, threat_scenario, risk_category IN ('High', 'Critical') AS flagged FROM rs LEFT JOIN sd USING (_username, date) "
         "WHERE _source = 'casb' AND daily_labeled_anomaly_count > 0)")


@query("a24_scenario_days", S.MATRIX + ", sd AS (SELECT DISTINCT _username, d AS date, scenario_id, threat_scenario FROM fm WHERE scenario_id IS NOT NULL) "
       "SELECT _username, CAST(date AS VARCHAR) AS date, scenario_id, threat_scenario FROM sd")
def a24(spark, sf):
    return E.scenario_days(unified_events(spark, sf)).select(
        "_username", F.col("date").cast("string").alias("date"), "scenario_id", "threat_scenario")


def scenario_join(spark, sf):
    return E.scored_scenario_days(risk(spark, sf), E.scenario_days(unified_events(spark, sf)), "casb")


@query("j10_scenario_join", S.RISK + f", {_SCEN} SELECT _username, CAST(date AS VARCHAR) AS date, scenario_id, flagged FROM sj")
def j10(spark, sf):
    return scenario_join(spark, sf).select("_username", F.col("date").cast("string").alias("date"), "scenario_id", "flagged")


@query("e7_scenario_recall", S.RISK + f", {_SCEN} SELECT scenario_id, threat_scenario, count(*) AS total_days, count(*) FILTER (WHERE flagged) AS caught, "
       "count(*) FILTER (WHERE NOT flagged) AS missed, round(count(*) FILTER (WHERE flagged) / count(*), 6) AS recall FROM sj WHERE scenario_id IS NOT NULL GROUP BY ALL")
def e7(spark, sf):
    return E.scenario_recall(scenario_join(spark, sf)).select(
        "scenario_id", "threat_scenario", "total_days", "caught", "missed", *r6("recall"))


@query("e7_missed_days", S.RISK + f", {_SCEN} SELECT _username, CAST(date AS VARCHAR) AS date, scenario_id, risk_category FROM sj WHERE NOT flagged")
def e7m(spark, sf):
    return E.missed_days(scenario_join(spark, sf)).select(
        "_username", F.col("date").cast("string").alias("date"), "scenario_id", "risk_category")
