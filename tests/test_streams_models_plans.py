import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from wardlight.operators import evaluation, models, outliers, point_in_time
from wardlight.session import materialize, scratch_path
from wardlight.streaming import intake, runner, scoring

SF = "/root/testdata/sf0.001"
EVENT = "event_id string, tenant_id string, user_id string, occurred_at timestamp, domain string"


def feed(spark, path, batches, schema):
    """One file per batch, written in order."""
    import time

    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def at(day, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour)


def test_first_sightings_expire_like_the_batch_form(spark):
    root = scratch_path(spark, "first")
    batches = [[("e1", "t", "u", at(0), "a"), ("e2", "t", "u", at(1), "a"), ("e3", "t", "u", at(1), "b")],
               [("e4", "t", "u", at(5), "a"), ("e5", "t", "v", at(5), "a")],
               [("e6", "t", "u", at(9), "b"), ("e7", "t", "u", at(11), "a"), ("e8", "t", "u", at(20), "a")],
               [("end", "t", "u", at(99), None)]]   # rows come out when the watermark has passed them
    stream = feed(spark, f"{root}/in", batches, EVENT)
    runner.run_available(scoring.first_sightings(stream, "domain"), lambda b, i: runner.write_once(b, f"{root}/out", i), f"{root}/cp")
    got = {r.event_id for r in spark.read.parquet(f"{root}/out").collect()}
    batch = point_in_time.first_uses(spark.createDataFrame([r for b in batches for r in b], EVENT), "domain")
    assert got == {r.event_id for r in batch.collect()} == {"e1", "e3", "e5", "e6", "e8"}


def test_ingest_keeps_one_row_per_id_over_batches_and_runs(spark):
    root = scratch_path(spark, "ingest")
    schema = EVENT
    first = [[("e1", "t", "u", at(0), "a"), ("e1", "t", "u", at(0), "a")], [("e1", "t", "u", at(0), "a"), ("e2", "t", "u", at(-30), "a")]]
    stream = feed(spark, f"{root}/in", first, schema)
    intake.ingest(stream, f"{root}/events", f"{root}/cp")
    again = feed(spark, f"{root}/in", [[("e2", "t", "u", at(-30), "a"), ("e3", "t", "u", at(2), "a")]], schema)
    intake.ingest(again, f"{root}/events", f"{root}/cp")
    assert sorted(r.event_id for r in spark.read.parquet(f"{root}/events").collect()) == ["e1", "e2", "e3"]


def test_batch_folder_replay_is_harmless(spark):
    path = scratch_path(spark, "replay")
    df = spark.range(3)
    runner.write_once(df, path, 7)
    runner.write_once(df, path, 7)
    assert spark.read.parquet(path).count() == 3


def test_candidates(spark):
    found = models.candidate_grid([("a", "c"), ("b",)], max_depth=[3, None], min_samples_split=[2], min_samples_leaf=[1])
    assert len(found) == 2 * 2 * 2
    assert models.Candidate(("a", "c"), None, 2, 1, "entropy") in found
    assert models.fitness(found[0], None, None, 3, min_features=3) == 0.0
    with pytest.raises(ValueError):
        models.candidate_grid([("a",)], max_depth=[4])
    with pytest.raises(ValueError):
        models.candidate_grid([("a",)], depth=[3])


def test_fitness_weighs_sources_equally(spark):
    data = [(float(i % 2), float(i % 2), i % 2, "big") for i in range(200)] + [(0.0, 1.0, int(i < 5), "small") for i in range(10)]
    df = spark.createDataFrame(data, "a double, b double, _label int, _source string")
    c = models.Candidate(("a",), 3, 2, 1, "gini")
    even = models.fitness(c, df, df, 2, min_features=1, penalty=0.0)
    pooled = models.fitness(c, df, df, 2, min_features=1, penalty=0.0, by_source=False)
    assert even == pytest.approx(0.5) and pooled > 0.95
    assert models.fitness(c, df, df, 2, min_features=1, penalty=0.1) == pytest.approx(even - 0.05)


def test_missing_feature_is_an_error(spark):
    df = spark.createDataFrame([(float(i % 2), i % 2) for i in range(40)], "a double, _label int")
    model = models.train(df, ["a"], models.tree(2))
    assert models.model_features(model) == ["a"]
    with pytest.raises(ValueError, match="missing features"):
        models.score_days(model, df.drop("a"))
    assert {r.classifier_score for r in models.score_days(model, df).collect()} == {0.0, 1.0}


def test_isolation_forest_finds_the_far_point(spark):
    data = [(f"r{i}", float(i % 7), float(i % 5)) for i in range(400)] + [("far", 90.0, -80.0)]
    df = spark.createDataFrame(data, "id string, x double, y double").repartition(4)
    got = outliers.isolation_forest(df, ["x", "y"], "id", trees=40)
    top = got.orderBy(F.desc("outlier_score")).first()
    assert top.id == "far" and top.outlier == 1 and got.count() == 401
    assert got.where("(outlier_score > 0.5) <> (outlier = 1)").count() == 0
    with pytest.raises(ValueError):
        outliers.isolation_forest(df.limit(9), ["x", "y"], "id")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


WIDE = ["m3_event_scores", "m12_risk_scores", "w3_trailing_baselines", "j14_point_in_time_signals", "m11_event_verdicts", "j9_catalogue_match",
        "j1_malicious_window", "e2_cutoff_sweep", "e4_observed_sweep", "a10_peer_baselines", "p37_event_alerts", "p41_related_alerts", "w5_user_split",
        "l3_sampled_matrix", "a11_user_profiles", "p5_imputed_events", "a15_leaderboard", "p17_sensitive_text"]


@pytest.mark.parametrize("name", WIDE)
def test_plans_have_no_products_and_no_python(spark, name):
    from verification.catalog import QUERIES

    plan = plan_of(QUERIES[name](spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert not re.search(r"Python|InPandas|MapInArrow", plan)


def test_no_window_without_partition_over_rows(spark):
    """Global ranks: the only unpartitioned window runs over bucket counts."""
    from verification.catalog import QUERIES

    plan = plan_of(QUERIES["w1_percentile_rank"](spark, SF))
    for exchange in re.findall(r"Exchange SinglePartition[^\n]*\n[^\n]*\n", plan):
        assert "_bucket" in exchange or "_rows" in exchange


def test_filters_and_columns_reach_the_scan(spark):
    from verification.catalog import QUERIES

    plan = plan_of(QUERIES["p18_redacted_log"](spark, SF))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)


FAST = ["p1_app_name", "p15_feature_matrix", "a3_daily_features", "m3_event_scores", "m12_risk_scores", "w4_keep_first", "p31_action_tiers",
        "a13_daily_trend", "e5_model_report", "w6_half_over_half", "j1_malicious_window", "w7_first_domain"]


@pytest.mark.parametrize("name", FAST)
def test_queries_match_their_sql(spark, name):
    from verification.catalog import ORACLE, QUERIES
    from verification.compare import check, duck

    status, n, _, note = check(name, QUERIES[name], ORACLE[name], spark, duck(SF), SF)
    assert status == "ok", note


def test_every_query_name_is_registered_once():
    from verification.catalog import ORACLE, QUERIES

    assert len(QUERIES) > 150 and set(ORACLE) <= set(QUERIES)


def test_replay_on_another_day_and_one_id_in_two_tenants(spark, tmp_path):
    from wardlight.streaming import intake

    def run(rows):
        folder = str(tmp_path / "in")
        spark.createDataFrame(rows, "tenant_id string, event_id string, occurred_at timestamp").coalesce(1).write.mode(
            "append").json(folder)
        stream = spark.readStream.schema("tenant_id string, event_id string, occurred_at timestamp").json(folder)
        intake.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"))

    day = dt.datetime(2024, 1, 1)
    run([("t1", "evt-1", day), ("t2", "evt-9", day)])
    run([("t1", "evt-1", day + dt.timedelta(days=8)), ("t1", "evt-9", day)])
    stored = spark.read.parquet(str(tmp_path / "out")).select("tenant_id", "event_id").collect()
    assert sorted(map(tuple, stored)) == [("t1", "evt-1"), ("t1", "evt-9"), ("t2", "evt-9")]


def test_report_makes_stored_predictions_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        made.add(1)
        return (i * 7 % 40) / 40

    rows = spark.range(40).select(F.lit("m").alias("model"), F.when(F.col("id") % 2 == 0, "casb").otherwise("cert").alias("_source"),
                                  (F.col("id") % 5 == 0).cast("int").alias("label"), score("id").alias("probability"))
    rows = rows.withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    plain = sorted(evaluation.model_report(rows).collect())
    made.value = 0
    stored = evaluation.model_report(rows, keep=lambda df, name: materialize(spark, df, name)).collect()
    assert made.value == 40 and sorted(stored) == plain and len(plain) == 3
