import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from wardlight.operators import catalogue, detect, evaluation, point_in_time, robust

SEC = ("event_id string, tenant_id string, user_id string, department string, occurred_at timestamp, event_type string, "
       "bytes_transferred bigint, domain string")
NOW = dt.datetime(2026, 8, 10, 2, 15)
CAT = ("ord int, name string, domain string, publisher string, category string, approval_state string, risk_weight int")
APPS = [(0, "Drive", "drive.test", None, "cloud", "approved", 5), (1, "Box", "box.test", None, "cloud", "unapproved", 25),
        (2, "Bot", "bot.test", "Bot Inc", "ai", "conditional", 10), (3, "Sub", "files.box.test", None, "cloud", "approved", 1)]


def sec(i, when, kind="activity", moved=0, domain=None, user="user-0001", dept="finance"):
    return (f"e{i:05}", "t", user, dept, when, kind, moved, domain)


def signals(df):
    return {r.event_id: [s.signal for s in r.signals] for r in df.collect()}


def package(rows, spark, events):
    e = catalogue.with_app(rows(events, SEC), rows(APPS, CAT))
    peers = robust.peer_baselines(robust.robust_user_baselines(rows(events, SEC)))
    return signals(point_in_time.evaluate(e, peers, "key"))


def test_new_and_unapproved_only_once(rows, spark):
    events = [sec(d, NOW - dt.timedelta(days=d + 1), domain="drive.test") for d in range(6)]
    events += [sec(100, NOW, domain="box.test"), sec(101, NOW + dt.timedelta(minutes=1), domain="box.test"),
               sec(102, NOW + dt.timedelta(minutes=2), domain="bot.test"), sec(103, NOW + dt.timedelta(days=6), domain="bot.test"),
               sec(104, NOW + dt.timedelta(days=14), domain="bot.test"), sec(105, NOW, domain="what.test", user="user-0009")]
    got = package(rows, spark, events)
    assert got["e00100"] == ["unapproved_app", "new_domain"]
    assert got["e00101"] == ["unapproved_app"]
    assert got["e00102"] == ["ai_tool_first_use", "new_domain"]
    assert got["e00103"] == []
    assert got["e00104"] == ["ai_tool_first_use"]  # eight days later; no baseline is left for new_domain
    assert got["e00105"] == ["unknown_application"]


def test_time_and_volume_after_a_week(rows, spark):
    events = []
    for d in range(6):
        day = NOW - dt.timedelta(days=d + 1)
        events += [sec(d, day + dt.timedelta(hours=7), "login"), sec(50 + d, day, "transfer", 1000, "drive.test")]
    events += [sec(100, NOW, "login"), sec(101, NOW, "transfer", 524_288_000, "box.test")]
    got = package(rows, spark, events)
    assert got["e00100"] == ["time_anomaly"]
    assert "volume_anomaly" in got["e00101"] and "peer_comparison" not in got["e00101"]


def test_engine_profile_and_cold_start(rows, spark):
    history = [sec(u * 100 + d, NOW - dt.timedelta(days=d + 1), "activity", 100 + d, "drive.test", f"user-{u:04}") for u in range(6) for d in range(9)]
    h = rows(history, SEC)
    users = robust.robust_user_baselines(h)
    peers, known = robust.peer_baselines(users), robust.known_domains(h, "key")
    fresh = rows([sec(9001, NOW, "transfer", 10**9, "box.test", "user-0001"), sec(9002, NOW, "transfer", 10**9, "box.test", "user-7777"),
                  sec(9003, NOW, "login", 0, "drive.test", "user-0001")], SEC)
    got = {r.event_id: r for r in detect.detect_engine(fresh, users, peers, known, "key").collect()}
    assert [s.signal for s in got["e09001"].signals] == ["volume_anomaly", "new_domain", "peer_comparison"]
    assert (got["e09001"].score, got["e09001"].severity, got["e09001"].tier) == (100, "critical", "R6")
    assert got["e09002"].signals == [] and got["e09002"].tier == "R1" and got["e09002"].confidence == 0.0
    assert got["e09003"].signals == []
    small = robust.peer_baselines(users.limit(3))
    few = detect.detect_engine(fresh, users, small, known, "key")
    assert all("peer_comparison" not in s for s in signals(few).values())


def test_login_centre_across_midnight(rows):
    hours = [(23, 30), (0, 15), (0, 30), (23, 50), (12, 0)]
    events = [sec(i, dt.datetime(2024, 1, 1 + i, h, m), "login") for i, (h, m) in enumerate(hours)]
    got = robust.login_pattern(robust.login_cells(rows(events, SEC))).first()
    assert got.login_hour_centre in (23 + 50 / 60, 0.25) and got.login_samples == 5
    assert got.login_hour_scale == 1.0


def test_rows_without_a_domain_pass_by_the_catalogue_join(rows):
    """Rows without a key keep their columns and repeat as often as before; none of them reaches the join."""
    data = [("a", "x.box.test", None), ("b", None, None), ("b", None, None), ("c", None, " bot inc "), ("d", "", "none"),
            ("e", "bot.test", None), (None, None, None)]
    df = rows(data, "id string, domain string, publisher string")
    got = catalogue.with_app(df, rows(APPS, CAT))
    assert got.columns == [*df.columns, "app"]
    assert sorted((r.id or "", r.app.name if r.app else "") for r in got.collect()) == [
        ("", ""), ("a", "Box"), ("b", ""), ("b", ""), ("c", "Bot"), ("d", ""), ("e", "Bot")]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join LeftOuter" in line]
    assert len(joins) >= 2 and "isnotnull(domain" in plan and "isnotnull(publisher" in plan
    assert catalogue.with_app(df.limit(0), rows(APPS, CAT)).count() == 0


def test_catalogue_suffix_and_order(rows):
    df = rows([("a", "X.Box.Test."), ("b", "files.box.test"), ("c", "abox.test"), ("d", None), ("e", "box.test")], "id string, domain string")
    got = {r.id: r.app and r.app.name for r in catalogue.with_app(df, rows(APPS, CAT)).collect()}
    assert got == {"a": "Box", "b": "Box", "c": None, "d": None, "e": "Box"}
    both = rows([("a", "files.box.test", "BOT inc "), ("b", None, "bot inc")], "id string, domain string, publisher string")
    assert {r.id: r.app.name for r in catalogue.with_app(both, rows(APPS, CAT)).collect()} == {"a": "Box", "b": "Bot"}


@pytest.mark.parametrize("seed", [1, 2])
def test_trailing_baselines_against_brute_force(rows, seed):
    rng = random.Random(seed)
    start, events = dt.datetime(2024, 1, 1), []
    for i in range(160):
        when = start + dt.timedelta(minutes=rng.randrange(14 * 24 * 12) * 5)
        events.append(sec(i, when, rng.choice(["login", "activity"]), rng.randrange(5) * 1000, rng.choice([None, "a.test", "b.test"]), rng.choice(["user-0001"] * 3 + ["user-0002"])))
    got = {r.event_id: r for r in point_in_time.trailing_baselines(rows(events, SEC).repartition(5), "k").collect()}

    def dial(a, b):
        return abs((a - b + 720) % 1440 - 720)

    for e in events:
        past = [h for h in events if h[2] == e[2] and e[4] - dt.timedelta(days=7) <= h[4] < e[4]]
        days = {}
        for h in past:
            days[h[4].date()] = days.get(h[4].date(), 0) + h[6]
        r = got[e[0]]
        assert r.sample_days == len(days)
        if days:
            assert r.daily_volume_median == statistics.median(days.values())
        assert bool(r.domain_known) == (e[7] is not None and any(h[7] == e[7] for h in past))
        if e[5] == "login":
            logins = sorted((h for h in past if h[5] == "login"), key=lambda h: h[4])
            minutes = [h[4].hour * 60 + h[4].minute for h in logins]
            assert r.login_samples == len(minutes)
            if minutes:
                best = min(sum(dial(m, c) for m in minutes) for c in minutes)
                centre = round(r.login_hour_centre * 60)
                assert sum(dial(m, centre) for m in minutes) == best and centre in minutes
                gaps = [dial(m, centre) for m in minutes]
                mid = statistics.median(gaps)
                want = 1.0 if len(gaps) < 2 else max(1.4826 * statistics.median(abs(g - mid) for g in gaps) / 60, 1.0)
                assert abs(r.login_hour_scale - want) < 1e-9


def test_first_sighting_ignores_bucket_size(rows):
    rng = random.Random(5)
    events = [sec(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(600)), domain=rng.choice(["a.test", "b.test", None])) for i in range(120)]
    df = rows(events, SEC)
    a, b = (sorted((r.event_id, r.last_seen_us or 0) for r in point_in_time.last_seen_before(df, "domain", bucket_us=us).collect())
            for us in (3_600_000_000, 10**15))
    assert a == b


def test_evaluation_small(rows):
    df = rows([(0.9, 1, "a"), (0.8, 0, "a"), (0.8, 1, "b"), (0.1, 0, "b"), (0.1, 0, "b")], "s double, l int, _source string")
    auc = evaluation.rank_auc(df, "s", "l").first()
    assert auc.auc == (3 + 2.5) / 6 and auc.n_pos == 2
    one_class = evaluation.rank_auc(df.where("l = 0"), "s", "l").first()
    assert one_class.auc is None
    sweep = {(r.cutoff, r._source): r for r in evaluation.cutoff_sweep(df, "s", "l", [0.5, 0.95]).collect()}
    assert (sweep[0.5, "(all)"].tp, sweep[0.5, "(all)"].fp, sweep[0.5, "(all)"].fn) == (2, 1, 0)
    assert sweep[0.95, "(all)"].flagged == 0 and sweep[0.95, "(all)"].f1 == 0.0 and sweep[0.5, "b"].tp == 1
    assert sorted(r.cutoff for r in evaluation.observed_cutoffs(df, "s").collect()) == pytest.approx([0.45, 0.85])


def test_user_split_is_stratified_and_stable(spark):
    data = [("s1" if u < 40 else "s2", f"u{u}", int(u % 10 == 0)) for u in range(41) for _ in range(3)]
    df = spark.createDataFrame(data, "_source string, _username string, _label int")
    a = {(r._source, r._username): r.is_test for r in evaluation.split_users(df).collect()}
    b = {(r._source, r._username): r.is_test for r in evaluation.split_users(df.repartition(9)).collect()}
    assert a == b and len(a) == 41
    assert sum(t for (s, u), t in a.items() if s == "s1" and int(u[1:]) % 10 == 0) == 1
    assert sum(t for (s, u), t in a.items() if s == "s1" and int(u[1:]) % 10) == 7
    assert not a["s2", "u40"]
    train, test = evaluation.train_test(df, evaluation.split_users(df))
    assert train.count() + test.count() == len(data)
    assert train.join(test, "_username", "left_semi").count() == 0


def test_best_cutoffs_search_every_observed_score(spark):
    rows = [(((i * 37) % 101) / 101.0, int((i * 37) % 101 > 60 + (i % 7)), f"s{i % 3}") for i in range(303)]
    rows += [(0.95, 1, "late"), (0.96, 1, "late"), (0.97, 1, "late"), (None, 1, "late"), (0.9, 0, "clean")]
    df = spark.createDataFrame(rows, "s double, bad int, _source string")
    seen = sorted({round(s, 6) for s, _, _ in rows if s is not None})
    cuts = [(a + b) / 2 for a, b in zip(seen, seen[1:])]
    assert len(cuts) > 30

    def best(mine):
        found = []
        for c in cuts:
            tp = sum(1 for s, y in mine if y and s is not None and s >= c)
            fp = sum(1 for s, y in mine if not y and s is not None and s >= c)
            fn = sum(y for _, y in mine) - tp
            found.append((2 * tp / (2 * tp + fp + fn) if tp else 0.0, -c))
        return max(found, key=lambda f: (round(f[0], 12), f[1]))

    got = {r._source: (r.f1, r.cutoff) for r in evaluation.best_observed_cutoffs(df, "s", "bad").collect()}
    expected = {"(all)": best([(s, y) for s, y, _ in rows])}
    expected |= {src: best([(s, y) for s, y, x in rows if x == src]) for src in ("s0", "s1", "s2", "late")}
    assert got.keys() == expected.keys()
    for name, (f1, cut) in expected.items():
        assert got[name] == (pytest.approx(f1), pytest.approx(-cut))


def test_equal_collector_records_stay_apart(spark):
    from wardlight.sources.canonical import collector_events
    from wardlight.schemas import COLLECTOR_LINE

    line = '{"timestamp": "2024-01-01T00:00:00Z", "kind": "browser", "user": "u", "device": "d", "domain": "x.com"}'
    records = spark.createDataFrame([(line,)] * 3 + [(line.replace('"u"', '"v"'),)], "j string").selectExpr(
        f"from_json(j, '{COLLECTOR_LINE}') AS r").select("r.*")
    first = sorted(r.event_id for r in collector_events(records, "t").collect())
    assert len(set(first)) == 4
    assert first == sorted(r.event_id for r in collector_events(records.repartition(3), "t").collect())


def test_fixed_limits_and_weights():
    from wardlight import fixed_values as fv

    assert fv.PERCENTILE_CUTOFFS == (70.0, 90.0, 97.0, 99.0)
    assert fv.PROBABILITY_CUTOFFS == (0.02, 0.10, 0.50, 0.90)
    assert fv.SCORER_CUTOFFS == (0.02, 0.10, 0.9926, 0.9984)
    assert (fv.CLASSIFIER_WEIGHT, fv.HEURISTIC_EVENT_AUC, fv.FEATURE_PENALTY) == (0.85, 0.6159, 0.03)
    assert (fv.REPEAT_THRESHOLD, fv.PEER_PREVALENCE_THRESHOLD, fv.MAD_TO_SIGMA) == (3, 0.40, 1.4826)
    assert fv.FLAGGED_CATEGORIES == ("High", "Critical")
    assert fv.TIER_ABOVE == {"R1": "R2", "R2": "R3", "R3": "R4", "R4": "R5", "R5": "R6", "R6": "R6"}
