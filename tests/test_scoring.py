import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.operators import baselines as B
from wardlight.operators import features as FE
from wardlight.operators import quality, ranking, risk, tiers
from wardlight.schemas import UNIFIED_EVENT


def event(spark, **fields):
    from pyspark.sql.types import StructType

    base = {"event_id": "e1", "timestamp": dt.datetime(2024, 1, 6, 6, 30), "agent_id": "a", "hostname": "h", "username": "u",
            "client_id": "t", "event_type": "login_event", "source": "s", "raw_data": {}}
    base.update(fields)
    return spark.createDataFrame([base], StructType.fromDDL(UNIFIED_EVENT))


def features(spark, **fields):
    return FE.feature_matrix(event(spark, **fields)).first().asDict()


def test_time_and_sentinels(spark):
    f = features(spark)
    assert (f["hour"], f["day_of_week"], f["is_weekend"], f["is_off_hours"], f["et_login_event"]) == (6, 5, 1, 1, 1)
    assert f["device_managed"] == f["has_admin_rights"] == f["is_departing_employee"] == -1
    assert features(spark, raw_data={"device_managed": 0})["device_managed"] == 0
    assert features(spark, timestamp=dt.datetime(2024, 1, 5, 7, 0))["is_off_hours"] == 0
    assert features(spark, timestamp=dt.datetime(2024, 1, 5, 19, 0))["is_off_hours"] == 1


def test_label_never_leaks(spark):
    names = set(FE.feature_matrix(event(spark)).columns)
    assert not names & {"risk_score", "risk_category", "risk_reasons", "mitre_tags"}
    a = features(spark, risk_score=90.0, risk_category="critical")
    assert a == features(spark, risk_score=1.0, risk_category="low")


def test_removable_media_and_domains(spark):
    for raw in ({"to_removable_media": True}, {"from_removable_media": True}, {"shadow_it_category": "Removable Media & Offline Transfer"}):
        assert features(spark, raw_data=raw)["is_removable_media"] == 1
    f = features(spark, destination_domain="My.DropBox.com", bytes_sent=99, raw_data={"auth_method": "none"})
    assert (f["is_exfil_domain"], f["domain_len"], f["weak_auth"]) == (1, 14, 1)
    assert math.isclose(f["bytes_sent_log"], math.log(100))


SCHEMA = "event_id string, ts timestamp, hour int, et_login_event int, device_managed int, _label int, _source string, _username string"


def small_matrix(rows, data):
    start = dt.datetime(2024, 1, 1)
    return rows([(f"e{i:03}", start + dt.timedelta(hours=i), *d) for i, d in enumerate(data)], SCHEMA)


def test_baselines_ignore_anomalies(rows):
    m = small_matrix(rows, [(8, 1, -1, 0, "s", "a"), (10, 0, -1, 0, "s", "a"), (99, 1, -1, 1, "s", "a"),
                            (5, 1, -1, 0, "s", "one"), (50, 1, -1, 1, "s", "bad")])
    users = {r.username: r for r in B.user_baselines(B.moments(m)).collect()}
    assert users["a"].event_count == 2 and users["a"].hour_mean == 9.0 and users["a"].labeled_anomaly_count == 1
    assert math.isclose(users["a"].hour_std, math.sqrt(2)) and users["a"].et_login_event_share == 0.5
    assert users["one"].hour_std == 0.0
    assert users["bad"].event_count == 0 and users["bad"].hour_mean is None and users["bad"].hour_std == 0.0
    stats = B.source_stats(B.moments(m)).first()
    assert (stats.n_total_events, stats.n_normal_events, stats.n_users) == (5, 3, 2)
    assert stats.anomaly_rate == 0.4 and stats.device_managed_std == 0.0
    assert {r.feature for r in B.zero_variance_columns(B.source_stats(B.moments(m))).collect()} == {"device_managed"}


def test_deviation_branches(rows):
    schema = "event_id string, hour int, device_managed int, is_new int, m_hour double, s_hour double, m_device_managed double, m_is_new double"
    df = rows([("clip", 20, -1, 1, 4.0, 0.5, 0.5, 0.25), ("half", 8, 1, 0, 4.0, 1.0, 0.75, 0.25), ("flat", 4, 0, 1, 4.0, 0.0, 1.0, None),
               ("jump", 5, 0, 1, 4.0, 0.0, 1.0, 9.0), ("null", 5, 0, 1, 4.0, None, None, 1.0)], schema)
    got = {r[0]: tuple(r)[1:] for r in df.selectExpr("event_id", *[B.deviation(f) for f in ("hour", "device_managed", "is_new")]).collect()}
    assert got["clip"] == (1.0, None, 0.75)
    assert got["half"] == (0.5, 0.25, 0.25)
    assert got["flat"] == (0.0, 1.0, None)
    assert got["jump"] == (1.0, 1.0, 1.0)
    assert got["null"] == (None, None, 0.0)


def test_contributors_order_and_text(rows):
    names = ["a", "b", "c"]
    df = rows([(0.5, 0.5, 0.9512), (0.0, None, 0.0), (1.0, 0.001, 0.0)], "d_a double, d_b double, d_c double")
    coded = df.withColumn("codes", F.expr(B.deviation_codes(names))).withColumn("c", B.contributors_of("codes", names, 2))
    assert [r[0] for r in coded.select(B.render_contributors("c")).collect()] == ["c=0.951; a=0.5", "", "a=1.0; b=0.001"]


def test_ranks_match_pandas_on_skew(spark):
    values = [0.5] * 400 + [i / 997 for i in range(300)] + [-3.5, 1e9, 0.0, 0.0]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double").repartition(7)
    got = {r.i: r.p for r in ranking.percentile_rank(df, "v", "p").collect()}
    want = pd.Series(values).rank(pct=True) * 100
    assert all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in range(len(values)))


def test_medians_and_positions(spark):
    data = [(k, i, float((i * 37) % 101)) for k, n in (("big", 500), ("one", 1), ("two", 2)) for i in range(n)]
    df = spark.createDataFrame(data, "k string, i int, v double").repartition(5)
    want = pd.DataFrame(data, columns=["k", "i", "v"]).groupby("k").v.median().to_dict()
    assert {r.k: r.median for r in ranking.median_by(df, "v", ["k"]).collect()} == want
    placed = ranking.numbered(df, ["k"], ["i"], F.floor(F.col("i") / 50))
    assert all(r.position == r.i for r in placed.collect())


def test_running_sums_count_strictly_earlier_rows(spark):
    import random

    rng = random.Random(1)
    data = [("u", rng.randrange(200), rng.randrange(9)) for _ in range(300)]
    df = spark.createDataFrame(data, "k string, t bigint, v bigint").repartition(6)
    got = sorted((r.t, r.v, r.s) for r in ranking.running_before(df, ["k"], "t", 17, {"s": F.col("v")}).collect())
    assert got == sorted((t, v, sum(b for _, a, b in data if a < t)) for _, t, v in data)


DAILY = ("_username string, _source string, date date, daily_max_score double, daily_mean_score double, "
         "daily_labeled_anomaly_count bigint, classifier_score double")


def test_risk_modes(rows):
    d = dt.date(2024, 1, 1)
    df = rows([(f"u{i}", "casb" if i % 2 else "cert", d, i / 10, i / 10, 0, i / 10) for i in range(10)], DAILY)
    plain = {r._username: r for r in risk.risk_scores(df.drop("classifier_score")).collect()}
    assert plain["u9"].risk_score == 100.0 and plain["u9"].risk_category == "Critical" and plain["u0"].risk_score == 10.0
    assert plain["u0"].scoring_mode == "heuristic_only"
    model = {r._username: r for r in risk.risk_scores(df, overrides={"casb": {"high": 0.2}}).collect()}
    assert model["u3"].risk_category == "High" and model["u4"].risk_category == "Medium"
    assert math.isclose(model["u4"].raw_composite_score, 0.4) and model["u4"].scoring_mode == "classifier+heuristic"


TIER = "risk_category string, repeat_count int, peer_prevalence double, self_audit_response string, is_known_bad_category boolean"


@pytest.mark.parametrize("row, tier", [
    (("Medium", 1, 0.0, None, False), "R2"), (("Medium", 4, 0.0, None, False), "R3"), (("Medium", 1, 0.43, None, False), "R4"),
    (("Critical", 1, 0.9, None, False), "R6"), (("Low", 1, 0.0, "denied", False), "R6"), (("Informational", 9, 0.9, None, False), "R1"),
    (("Low", 1, 0.0, None, True), "R5"), (("Medium", 1, 0.4, None, True), "R4"), (("High", 3, 0.0, "confirmed", False), "R4"),
    (("Informational", 1, 0.0, None, True), "R5"), (("Critical", 5, 0.0, None, True), "R6")])
def test_action_tiers(rows, row, tier):
    got = tiers.with_action_tier(rows([row], TIER)).first()
    assert got.r_tier == tier and got.r_tier_explanation


def test_bad_tier_inputs(rows):
    bad = [("Odd", 1, 0.0, None, False), ("Low", -1, 0.0, None, False), ("Low", 1, 1.5, None, False), ("Low", 1, 0.0, "maybe", False)]
    marked = tiers.with_action_tier(rows(bad, TIER), on_error="mark").collect()
    assert all(r.r_tier_error for r in marked)
    with pytest.raises(Exception, match="risk_category"):
        tiers.with_action_tier(rows(bad[:1], TIER)).collect()


def test_remediation_statuses(rows):
    from wardlight.sources.dimensions import parse_remediation

    doc = "# x\n\n## 9.4 Cloud — y\n\n**Fix 1 — Do a.** *(Verified)*\n\n**Fix 2 — Do b.** *(Practice)*\n**Fix 1 — Do c.** *(P)*\n## 9.6 AI\nnothing\n"
    table = parse_remediation(rows([(doc,)], "value string"))
    d = dt.date(2024, 1, 1)
    days = rows([("a", "casb", d, "Unapproved Cloud Storage & File Sharing", None), ("b", "casb", d, "Unauthorized Software Installs", None),
                 ("c", "casb", d, "Nope", None), ("d", "cert", d, None, "is_exfil_domain"), ("e", "cert", d, None, None),
                 ("f", "casb", d, "Unsanctioned AI Tools", None), ("g", "cert", d, None, "odd")],
                "_username string, _source string, date date, shadow_it_category string, cert_signal string")
    got = {r._username: r for r in tiers.attach_remediation(days, table, "casb").collect()}
    assert {k: v.recommendation_status for k, v in got.items()} == {
        "a": "ok", "b": "section_not_found", "c": "unknown_category", "d": "ok", "e": "no_signal", "f": "ok", "g": "no_match"}
    assert [f.title for f in got["a"].recommended_fixes] == ["Do a", "Do b"] and got["a"].recommended_section == "Cloud"
    assert got["f"].recommended_fixes == []


def test_normalize_and_duplicates(spark):
    e = event(spark, username="  bob ", event_type="cloud_upload", app_name="Box (x)", destination_domain="HTTP://www.A.com/x", is_anomaly=None)
    e = e.withColumn("input_ord", F.lit(1)).unionByName(e.withColumn("input_ord", F.lit(0)).withColumn("hostname", F.lit("first")))
    clean = quality.normalize(quality.keep_first(e)).first()
    assert (clean.hostname, clean.username, clean.app_name, clean.destination_domain) == ("first", "bob", "Box", "a.com")
    assert (clean.bytes_sent, clean.bytes_received, clean.file_size_kb, clean.is_anomaly) == (0, 0, 0.0, False)
    assert clean.raw_data.app_name_original == "Box (x)" and clean.error is None and clean.n_filled == 6
    blank = quality.normalize(event(spark, username="   "))
    assert quality.quarantine_rows(blank).count() == 1 and quality.good_rows(blank).count() == 0


def test_ingest_status_of_a_union_of_joined_rows(spark, tmp_path):
    """Copies by a union of two shuffled joins, neither side broadcast: their partitions are merged while the query runs."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, parts, column in (("events", 5, "id * 2 AS input_ord"), ("numbers", 3, "id % 10 AS k")):
            spark.range(0, 3000, 1, parts).selectExpr("concat('e', id) AS event_id", column).write.parquet(f"{tmp_path}/{name}")
        numbers = spark.read.parquet(f"{tmp_path}/numbers")
        events = spark.read.parquet(f"{tmp_path}/events").join(numbers, "event_id")
        copies = events.where("k = 7").withColumn("input_ord", F.col("input_ord") + 1)
        found = quality.ingest_status(events.unionByName(copies), numbers.where("k >= 5"))
        found.write.parquet(f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    counts = dict(spark.read.parquet(f"{tmp_path}/out").groupBy("status").count().collect())
    assert counts == {"accepted": 1500, "duplicate": 1800}
