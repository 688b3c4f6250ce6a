"""Streams over files that Spark writes from the test tables, run until nothing is left."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from verification import sql as S
from verification.alert_queries import heartbeats
from verification.behaviour_queries import ENGINE, baselines
from verification.binding import canonical_events, flat_events, security_events, table
from verification.registry import query
from verification.scalar_queries import _KEY, MESSY, messy_events
from verification.source_queries import _KIND, siem_hits
from verification.window_queries import TRAILING
from wardlight.session import release_shuffles, scratch_path
from wardlight.streaming import intake, runner, scoring

EV = S.ctes(S.EV)


def stream_of(spark, df, name, files_per_batch=None, parts=None):
    """The frame as a file stream."""
    path = scratch_path(spark, name)
    (df.repartition(parts) if parts else df).write.parquet(path)
    reader = spark.readStream.schema(df.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


@query("r1_alert_intake", EV + f"SELECT event_id, {_KIND} AS event_type FROM ev")
def r1(spark, sf):
    root = scratch_path(spark, "r1")
    siem_hits(spark, sf).select("_id", "_source").repartition(6).write.json(f"{root}/in")
    out = f"{root}/out"
    runner.run_available(intake.hit_stream(spark, f"{root}/in", "tenant-a", 2),
                         lambda b, i: runner.write_once(b, out, i), f"{root}/cp")
    return spark.read.parquet(out).select("event_id", "event_type")


@query("r2_replay_safe_ingest", EV + "SELECT event_id, client_id AS tenant_id FROM ev")
def r2(spark, sf):
    c = canonical_events(spark, sf)
    again = c.unionByName(c.where(F.xxhash64("event_id") % 3 == 0))
    root = scratch_path(spark, "r2")
    intake.ingest(intake.replay_safe(stream_of(spark, again, "r2-in", 2, 4), "40 days"), f"{root}/events", f"{root}/cp")
    return spark.read.parquet(f"{root}/events").select("event_id", "tenant_id")


@query("r6_backdated_events", EV + "SELECT client_id AS tenant_id, count(*) AS n_events, epoch_us(max(ts)) AS newest_event_us, true AS arrived_later FROM ev GROUP BY 1")
def r6(spark, sf):
    root = scratch_path(spark, "r6")
    intake.ingest(stream_of(spark, canonical_events(spark, sf), "r6-in"), f"{root}/events", f"{root}/cp")
    stored = spark.read.parquet(f"{root}/events")
    return stored.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.unix_micros(F.max("occurred_at")).alias("newest_event_us"),
        (F.max("ingested_at") > F.max("occurred_at")).alias("arrived_later"))


@query("r3_score_on_ingest", ENGINE + "SELECT event_id, CAST(round_even(top * confidence, 0) AS INT) AS score FROM ef")
def r3(spark, sf):
    root = scratch_path(spark, "r3")
    users, peers, known = baselines(spark, sf)
    for name, df in (("users", users), ("peers", peers), ("known", known)):
        df.write.parquet(f"{root}/{name}")
    stored = [spark.read.parquet(f"{root}/{n}") for n in ("users", "peers", "known")]
    scoring.score_on_ingest(stream_of(spark, security_events(spark, sf), "r3-in", 2, 4), lambda: stored, _KEY,
                            f"{root}/scores", f"{root}/bad", f"{root}/cp")
    return spark.read.parquet(f"{root}/scores").select("event_id", "score")


@query("r7_first_sightings", TRAILING + "SELECT se.event_id, domain AS token FROM se LEFT JOIN kn ON se.event_id = kn.eid2 WHERE domain IS NOT NULL AND kn.eid2 IS NULL")
def r7(spark, sf):
    """Shuffled over four batches inside the delay; a last event without a token moves the watermark past all of them."""
    root = scratch_path(spark, "r7")
    out, events = f"{root}/out", security_events(spark, sf)
    closing = events.agg(F.max("occurred_at").alias("t")).select(*(
        (F.col("t") + F.expr("INTERVAL 100 DAYS") if f.name == "occurred_at" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in events.schema))
    events.repartitionByRange(7, F.xxhash64("event_id")).write.parquet(f"{root}/in")
    closing.write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    runner.run_available(scoring.first_sightings(stream, "domain", "90 days"), lambda b, i: runner.write_once(b, out, i), f"{root}/cp")
    return spark.read.parquet(out).select("event_id", "token")


@query("r8_connector_liveness", EV + "SELECT client_id AS tenant_id, max_by(CASE WHEN k % 10 = 0 THEN 'error' ELSE 'ok' END, ts) AS status, epoch_us(max(ts)) AS polled_us FROM ev GROUP BY client_id")
def r8(spark, sf):
    root = scratch_path(spark, "r8")
    intake.liveness(stream_of(spark, heartbeats(spark, sf), "r8-in", 2, 4), f"{root}/live", f"{root}/cp")
    return intake.current_liveness(spark, f"{root}/live").select("tenant_id", "status", F.unix_micros("polled_at").alias("polled_us"))


@query("r9_incremental_normalize", MESSY + "SELECT DISTINCT t || client_id AS tenant_id, event_id, CASE WHEN trim(username) = '' "
       "THEN 'quarantine' ELSE 'accepted' END AS outcome FROM messy, (SELECT unnest(['', 'b-']) AS t) WHERE t = '' OR k % 5 <> 1")
def r9(spark, sf):
    """Two clients with the same event ids; the second lacks some of them."""
    root = scratch_path(spark, "r9")
    lines = messy_events(spark, sf).drop("input_ord")
    other = lines.join(flat_events(spark, sf).where("k % 5 <> 1").select("event_id"), "event_id")
    both = lines.unionByName(other.withColumn("client_id", F.concat(F.lit("b-"), "client_id")))
    # Two batches of files that do not grow with the table; all lines of an id lie in one of them.
    files = max(4, 2 * math.ceil(table(spark, sf, "events").count() / 250_000))
    both.repartition(files, "event_id").write.option("compression", "gzip").json(f"{root}/in")
    release_shuffles(spark)
    intake.normalize_files(spark, f"{root}/in", f"{root}/events", f"{root}/quarantine", f"{root}/cp", files // 2)
    good = spark.read.parquet(f"{root}/events").select(F.col("client_id").alias("tenant_id"), "event_id", F.lit("accepted").alias("outcome"))
    ids = both.select(F.col("client_id").alias("tenant_id"), "event_id").distinct()
    bad = spark.read.parquet(f"{root}/quarantine").select("client_id", "event_id").withColumnRenamed("client_id", "tenant_id")
    return good.unionByName(bad.distinct().join(ids, ["tenant_id", "event_id"]).select("tenant_id", "event_id", F.lit("quarantine").alias("outcome")))


@query("r10_daily_counts", EV + "SELECT CAST(d AS VARCHAR) AS date, username AS user_id, count(*) AS n_events FROM ev WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR GROUP BY ALL")
def r10(spark, sf):
    root = scratch_path(spark, "r10")
    events = flat_events(spark, sf).select(F.col("username").alias("user_id"), F.col("ts").alias("occurred_at"))
    out = f"{root}/out"
    runner.run_available(intake.daily_counts(stream_of(spark, events, "r10-in")), lambda b, i: runner.write_once(b, out, i), f"{root}/cp")
    return spark.read.parquet(out).select(F.col("date").cast("string").alias("date"), "user_id", "n_events")


@query("r10_late_events", EV + """, w AS (SELECT max(ts) - INTERVAL 1 HOUR AS first_mark FROM ev WHERE k % 3 = 1),
l AS (SELECT count(*) AS late FROM ev, w WHERE k % 3 = 0 AND d + INTERVAL 1 DAY <= first_mark),
o AS (SELECT count(*) AS open FROM ev, w WHERE d + INTERVAL 1 DAY > (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR)
SELECT (SELECT count(*) FROM ev) AS arrived, (SELECT count(*) FROM ev) - open - late AS counted, 0::bigint AS open_before, open AS open_after, late FROM l, o""")
def r10_late(spark, sf):
    """Three batches of a third of all events each; the second closes the days of the first, the third comes late."""
    root = scratch_path(spark, "r10-late")
    events = flat_events(spark, sf).select(F.col("username").alias("user_id"), F.col("ts").alias("occurred_at"), "k")
    for part in ("k % 3 = 1", "k % 3 = 2", "k % 3 = 0"):
        events.where(part).drop("k").coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(events.drop("k").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    return intake.count_days(stream, f"{root}/out", f"{root}/cp")
