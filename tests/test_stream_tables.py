"""Out-of-order first sightings, the key index, compaction, late events and the nightly chain."""

import datetime as dt
import itertools
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wardlight.operators import point_in_time
from wardlight.plans import nightly
from wardlight.session import scratch_path
from wardlight.sources import sinks
from wardlight.streaming import intake, runner, scoring
from wardlight.streaming.tables import FAN, BatchTable, KeyIndex, Pointer

EVENT = "event_id string, tenant_id string, user_id string, occurred_at timestamp, domain string"
START = dt.datetime(2024, 1, 1)


def stream_files(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_first_sightings_in_any_order_of_arrival(spark):
    rng = np.random.default_rng(4)
    rows = [(f"e{i}", "t", f"u{rng.integers(2)}", START + dt.timedelta(hours=int(rng.integers(0, 30 * 24))), f"d{rng.integers(6)}")
            for i in range(240)]
    rows += [(f"x{i}", "t", "u0", rows[i][3], rows[i][4]) for i in range(20)]   # equal times
    order = rng.permutation(len(rows))
    batches = [[rows[i] for i in part] for part in np.array_split(order, 4)]
    root = scratch_path(spark, "any-order")
    stream = stream_files(spark, f"{root}/in", [*batches, [("end", "t", None, START + dt.timedelta(days=99), None)]], EVENT)
    runner.run_available(scoring.first_sightings(stream, "domain", "40 days"), lambda b, i: runner.write_once(b, f"{root}/out", i), f"{root}/cp")
    got = sorted(r.event_id for r in spark.read.parquet(f"{root}/out").collect())
    batch = point_in_time.first_uses(spark.createDataFrame(rows, EVENT), "domain")
    assert got == sorted(r.event_id for r in batch.collect()) and len(got) < len(rows)


@pytest.mark.parametrize("seed", range(30))
def test_thinned_sightings_answer_like_all_of_them(seed):
    rng = np.random.default_rng(seed)
    window, newest = 10, int(rng.choice([-1, 0, 3]))
    us = rng.integers(newest + 1, 60, rng.integers(1, 25))
    ids = np.array([f"e{i}" for i in range(len(us))], dtype=object)
    half = len(us) // 2   # in two chunks, as they arrive
    some = scoring.thinned(us[:half], ids[:half], newest, window)
    got_us, got_ids = scoring.thinned(np.concatenate([some[0], us[half:]]), np.concatenate([some[1], ids[half:]]), newest, window)

    def seen(times, t):
        return any(t - window <= x < t for x in times)

    known = [*us, *([newest] if newest >= 0 else [])]
    assert {i for i in got_ids if i} == {i for t, i in zip(us, ids) if not seen(known, t)}
    kept = [*got_us, *([newest] if newest >= 0 else [])]
    assert all(seen(known, t) == seen(kept, t) for t in range(newest + 1, 90))


def test_a_users_tokens_are_one_state_value_with_one_timer():
    """Each call for a key's state costs more than its few rows: one read, one write and at most one timer a batch."""
    class Handle:
        calls, value, timers = [], None, set()

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    day = scoring.DAY_US
    handle, processor = Handle(), scoring.FirstSighting(30 * day)
    processor.init(handle)
    rows = [Row(token=f"d{i % 3}", event_id=f"e{i}", us=(9 - i) * day) for i in range(9)] + [Row(token="d0", event_id=None, us=5 * day)]
    for part in (rows[:4], rows[4:]):
        assert list(processor.handleInputRows(("t", "u"), iter(part), None)) == []
    assert handle.calls == ["get", "update"] * 2 and handle.timers == {day // 1000 + 1}

    def passed(days):
        handle.timers.clear()
        at = SimpleNamespace(getCurrentWatermarkInMs=lambda: days * day // 1000)
        return [(r.token, r.event_id) for r in processor.handleExpiredTimer(("t", "u"), at, None)]

    assert passed(2) == [("d1", "e7"), ("d2", "e8")] and len(handle.timers) == 1
    assert passed(20) == [("d0", "e6")] and handle.timers == {37 * day // 1000 + 1}   # d2's newest is at day 7
    assert passed(60) == [] and handle.value is None and not handle.timers


def test_pointer_and_levels_of_runs(spark):
    path = scratch_path(spark, "levels")
    table = BatchTable(spark, path, "id bigint")
    for batch in range(2 * FAN + 1):
        table.append(spark.range(batch * 10, batch * 10 + 10), batch)
        table.append(spark.range(batch * 10, batch * 10 + 10), batch)   # replayed
        table.compact(batch - 1)
    upto, runs = table.state()
    assert upto == 2 * FAN - 1 and runs == ["1-7", "1-15"]
    assert table.tail(upto) == [2 * FAN]
    assert sorted(r.id for r in table.read().collect()) == list(range(10 * (2 * FAN + 1)))
    assert Pointer(spark, f"{path}/nothing").get() is None


def test_readers_keep_the_folders_they_looked_up(spark):
    table = BatchTable(spark, scratch_path(spark, "readers"), "id bigint")
    for batch in range(4):
        table.append(spark.range(batch, batch + 1), batch)
    table.compact(1)
    before = table.load(table.folders())
    table.compact(2)
    assert sorted(r.id for r in before.collect()) == [0, 1, 2, 3]
    table.compact(3)
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2, 3]


def test_key_index_over_batches_runs_and_replays(spark):
    index = KeyIndex(spark, scratch_path(spark, "index"), ("tenant", "id"), buckets=16, compact_every=3)
    rng, stored = np.random.default_rng(1), set()
    for batch in range(12):
        rows = [(f"t{rng.integers(2)}", f"e{rng.integers(60)}") for _ in range(15)]
        frame = spark.createDataFrame(sorted(set(rows)), "tenant string, id string")
        expected = set(rows) - stored
        for _ in range(2 if batch % 4 == 0 else 1):   # a replayed batch stores the same again
            fresh = index.unseen(frame, batch)
            assert {tuple(r) for r in fresh.collect()} == expected
            index.add(fresh, batch)
        stored |= expected
    upto, runs = index.table.state()
    assert upto >= 8 and runs
    one = spark.createDataFrame([("t0", "e1")], "tenant string, id string")
    files = index.unseen(one, 12).inputFiles()
    in_runs = {f.split("_bucket=")[1].split("/")[0] for f in files if "_bucket=" in f}
    assert len(in_runs) <= 1   # of the runs, the one bucket of the key


def test_index_of_a_table_that_had_none(spark):
    stored = spark.createDataFrame([("a", 0), ("b", 1), ("c", 5)], "id string, batch_id int")
    index = KeyIndex(spark, scratch_path(spark, "adopted"), ("id",), buckets=4, compact_every=2)
    index.adopt(stored, 5)
    index.adopt(stored, 6)   # only once
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [r.id for r in index.unseen(rows, 5).collect()] == ["c"]
    for batch in range(5, 12):
        index.add(index.unseen(rows, batch), batch)
    assert index.unseen(rows, 12).count() == 0


def test_liveness_reads_runs_and_the_tail(spark):
    root = scratch_path(spark, "live")
    schema = "tenant_id string, polled_at timestamp, status string, events_found bigint, detail string"
    batches = [[(f"t{i % 3}", START + dt.timedelta(minutes=i), f"s{i}", i, "")] for i in range(9)]
    intake.liveness(stream_files(spark, f"{root}/in", batches, schema), f"{root}/live", f"{root}/cp", compact_every=3)
    table = BatchTable(spark, f"{root}/live")
    assert table.state()[1] and len(table.folders()) < 9
    assert sorted((r.tenant_id, r.status) for r in intake.current_liveness(spark, f"{root}/live").collect()) == [
        ("t0", "s6"), ("t1", "s7"), ("t2", "s8")]


def test_same_id_of_two_clients_is_normalized_twice(spark):
    root = scratch_path(spark, "clients")
    line = '{"event_id": "e1", "client_id": "%s", "username": "u", "event_type": "login_event", "timestamp": "2024-01-0%dT00:00:00Z"}'
    for day, clients in ((1, ["a", " b "]), (2, ["b", "c", ""])):
        spark.createDataFrame([(line % (c, day),) for c in clients], "value string").coalesce(1).write.mode("append").text(f"{root}/in")
        intake.normalize_files(spark, f"{root}/in", f"{root}/out", f"{root}/bad", f"{root}/cp")
    assert sorted(r.client_id for r in spark.read.parquet(f"{root}/out").collect()) == ["a", "b", "c"]
    assert [r.client_id for r in spark.read.parquet(f"{root}/bad").collect()] == [""]


def test_late_events_over_more_than_a_hundred_batches(spark):
    root = scratch_path(spark, "late")
    schema = "user_id string, occurred_at timestamp"
    rows = []
    for i in range(104):   # a day further in each batch, and from the third on two events of the first day, one user twice
        rows.append([("u", START + dt.timedelta(days=i, hours=2)), *([("u", START)] * 2 if i >= 3 else [])])
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{root}/one/{i}")
    import os
    os.makedirs(f"{root}/in")
    for i in range(len(rows)):
        (part,) = [f for f in os.listdir(f"{root}/one/{i}") if f.endswith(".parquet")]
        target = f"{root}/in/{i:04d}.parquet"
        os.link(f"{root}/one/{i}/{part}", target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        run = intake.count_days(stream, f"{root}/out", f"{root}/cp").first()
        assert (run.arrived, run.late) == (104 + 2 * 101, 2 * 101)
        assert run.counted == 103 and run.open_after == 1
        again = intake.count_days(stream, f"{root}/out", f"{root}/cp").first()   # nothing new
        assert (again.arrived, again.counted, again.late) == (0, 0, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_running_stream_takes_up_new_baselines(spark):
    from verification.binding import security_events
    from verification.scalar_queries import _KEY

    sf, root = "/root/testdata/sf0.001", scratch_path(spark, "nightly")
    events = security_events(spark, sf)
    users, peers, known = (x.cache() for x in _baselines(events, _KEY))
    path = f"{root}/in"
    events.where(F.xxhash64("event_id") % 2 == 0).coalesce(1).write.parquet(path)
    time.sleep(0.05)
    events.where(F.xxhash64("event_id") % 2 != 0).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    versions = itertools.chain([(users.limit(0), peers.limit(0), known.limit(0))], itertools.repeat((users, peers, known)))
    scoring.score_on_ingest(stream, lambda: next(versions), _KEY, f"{root}/scores", f"{root}/bad", f"{root}/cp")
    days = {r.batch_id: r.n for r in spark.read.parquet(f"{root}/scores").groupBy("batch_id").agg(
        F.count("sample_days").alias("n")).collect()}
    assert days[0] == 0 and days[1] > 0


def _baselines(events, key):
    from wardlight.operators import robust

    users = robust.robust_user_baselines(events)
    return users, robust.peer_baselines(users), robust.known_domains(events, key)


def test_baseline_versions_are_published_whole(spark):
    from verification.binding import canonical_events
    from verification.scalar_queries import _KEY

    root = scratch_path(spark, "versions")
    canonical = canonical_events(spark, "/root/testdata/sf0.001").cache()
    store = nightly.BaselineStore(spark, root, _KEY)
    with pytest.raises(ValueError):
        store.current()
    last = canonical.agg(F.max("occurred_at")).first()[0]
    store.refresh(canonical, last - dt.timedelta(days=10), "a")
    first = {r.user_id: r for r in store.current()[0].collect()}
    held = store.current()
    store.refresh(canonical, last, "b")
    second = {r.user_id: r for r in store.current()[0].collect()}
    window = {r.user_id for r in nightly.refresh_baselines(canonical, last, _KEY)[0].collect()}
    assert set(second) == set(first) | window
    assert all(second[u] == first[u] for u in set(first) - window)
    assert {r.user_id for r in held[0].collect()} == set(first)   # the version a batch holds does not change
    assert store.refresh(canonical, last, "b")[0].count() == len(second)


def test_user_day_counts_and_scores(spark):
    from verification.binding import canonical_events
    from wardlight.operators import models

    root = scratch_path(spark, "user-days")
    canonical = canonical_events(spark, "/root/testdata/sf0.001").cache()
    last = canonical.agg(F.max("occurred_at")).first()[0]
    days = nightly.live_user_days(canonical, last)
    features = [c for c, t in days.dtypes if t in ("double", "int", "bigint") and c not in ("n_events",)][:6]
    labelled = days.withColumn("_label", (F.xxhash64("_username", "date") % 2 == 0).cast("int"))
    model = models.train(labelled, features, models.tree(3))
    counts = nightly.publish_user_days(canonical, model, last, f"{root}/scores").first()
    stored = sinks.read_table(spark, f"{root}/scores")
    assert counts.user_days_scored == stored.count() and stored.where("computed_at IS NULL").count() == 0
    assert counts.user_days_scored + counts.user_days_informational_skipped == days.count()
    assert counts.events_considered == nightly.trailing(canonical, last).count()


def test_input_of_incremental_normalize_is_compressed(spark, tmp_path, monkeypatch):
    """The lines that r9 writes for its stream are most of its disk; the same rows come back from them."""
    from datetime import datetime

    from verification import stream_queries

    class Stop(Exception):
        pass

    tables = {
        "events": ([(i, datetime(2024, 1, 1, i % 24), i % 5, "view", 1.5 * i, '{"k": %d}' % i) for i in range(40)],
                   "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"),
        "customer": ([(i, 0) for i in range(5)], "c_custkey bigint, c_nationkey int"),
        "nation": ([(0, 0)], "n_nationkey int, n_regionkey int"), "region": ([(0, "ASIA")], "r_regionkey int, r_name string")}
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    seen = []

    def stop(spark, source, *rest):
        seen.append(source)
        raise Stop

    monkeypatch.setattr(stream_queries.intake, "normalize_files", stop)
    with pytest.raises(Stop):
        stream_queries.r9(spark, str(tmp_path))
    files = spark.read.json(seen[0])
    assert files.inputFiles() and all(name.endswith(".json.gz") for name in files.inputFiles())
    # 40 events and 6 later copies; the second client lacks the 8 of k % 5 = 1 and a copy.
    assert files.where("client_id like 'tenant%'").count() == 46 and files.where("client_id like 'b-%'").count() == 37
