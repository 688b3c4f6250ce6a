"""Streaming intake: alert hits, replay-safe ingest, incremental normalization, liveness, daily counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.functions.text import strip
from wardlight.operators.quality import good_rows, keep_first, normalize
from wardlight.schemas import SIEM_HIT, UNIFIED_EVENT
from wardlight.session import release_shuffles
from wardlight.sources.files import exists
from wardlight.sources.siem import hit_events
from wardlight.streaming.runner import batch_folder, read_batches, run_available, write_once
from wardlight.streaming.tables import COMPACT_EVERY, BatchTable, KeyIndex


def hit_stream(spark: SparkSession, path: str, tenant: str, files_per_batch: int = 100) -> DataFrame:
    """Index hits as they arrive as files; the checkpoint remembers what was read."""
    hits = spark.readStream.schema(SIEM_HIT).option("maxFilesPerTrigger", files_per_batch).json(path)
    return hit_events(hits, tenant)


def replay_safe(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """R2: one row per (tenant, event) among rows that arrive within the delay of each other."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["tenant_id", "event_id"])


def ingest(events: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY):
    """Append new events; ids stored before are left out at any age.

    ``ingested_at`` is kept apart from ``occurred_at``, so backdated events stay
    visible as fresh arrivals. The stored table is partitioned by event day. Stored ids are found in an
    index beside it (``path``-ids), of which a batch reads the buckets of its own ids.
    """
    spark, keys = events.sparkSession, ("tenant_id", "event_id")
    index = KeyIndex(spark, f"{path}-ids", keys, compact_every=compact_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        index.adopt(read_batches(spark, path), batch_id)
        rows = (batch.dropDuplicates(list(keys))
                .withColumn("ingested_at", F.current_timestamp())
                .withColumn("event_date", F.to_date("occurred_at"))).persist()
        try:
            write_once(index.unseen(rows, batch_id), path, batch_id, by="event_date")
        finally:
            rows.unpersist()
        # What was stored is indexed, so a replay indexes the rows it wrote.
        index.add(spark.read.schema(batch.schema).parquet(batch_folder(path, batch_id)), batch_id)

    return run_available(events, write, checkpoint)


def freshness(stored: DataFrame) -> DataFrame:
    """Newest event time and newest arrival."""
    return stored.agg(F.max("occurred_at").alias("newest_event"), F.max("ingested_at").alias("newest_arrival"))


def normalize_files(spark: SparkSession, source: str, events_path: str, quarantine_path: str,
                    checkpoint: str, files_per_batch: int = 100):
    """Normalize new event files; events written before are skipped; two outputs per batch.

    An event is known by its client and id, so clients may use the same ids.
    """
    schema = UNIFIED_EVENT + ", _corrupt_record string"
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    keys = ("client_id", "event_id")
    index = KeyIndex(spark, f"{events_path}-ids", keys)

    def write(batch: DataFrame, batch_id: int) -> None:
        index.adopt(read_batches(spark, events_path), batch_id)
        broken = F.col("_corrupt_record").isNotNull() | F.col("event_id").isNull() | F.col("timestamp").isNull()
        batch = batch.withColumn("client_id", strip(F.coalesce("client_id", F.lit("")))).persist()
        try:
            bad = batch.where(broken).select("client_id", "event_id", F.lit("parse/validate").alias("error"))
            rows = batch.where(~broken).drop("_corrupt_record").withColumn("event_date", F.to_date("timestamp"))
            # Inside one file batch the arrival order is not kept: the earliest copy counts.
            first = keep_first(rows, F.struct("timestamp", "hostname"), keys=keys)
            checked = normalize(index.unseen(first, batch_id))
            write_once(good_rows(checked), events_path, batch_id, by="event_date")
            rejected = checked.where(F.col("error").isNotNull()).select("client_id", "event_id", "error")
            write_once(bad.unionByName(rejected), quarantine_path, batch_id)
        finally:
            batch.unpersist()
        index.add(spark.read.schema("client_id string, event_id string").parquet(batch_folder(events_path, batch_id)), batch_id)
        release_shuffles(spark)

    return run_available(lines, write, checkpoint)


_HEARTBEAT = ("polled_at", "status", "events_found", "detail")


def _newest_heartbeat(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tenant_id").agg(F.max(F.struct(*_HEARTBEAT)).alias("h")).select("tenant_id", "h.*")


def _liveness_table(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, path, merge=_newest_heartbeat)


def liveness(heartbeats: DataFrame, path: str, checkpoint: str, compact_every: int = COMPACT_EVERY):
    """Newest heartbeat per tenant, kept current in update mode; update batches are compacted on the way."""
    table = _liveness_table(heartbeats.sparkSession, path)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.append(batch, batch_id)
        if batch_id - max(table.state()[0], -1) > compact_every:
            table.compact(batch_id - 1)

    return run_available(_newest_heartbeat(heartbeats), write, checkpoint, mode="update")


def current_liveness(spark: SparkSession, path: str) -> DataFrame:
    """The newest row per tenant: compacted runs and the update batches after them."""
    return _liveness_table(spark, path).read()


ARRIVED = "user_day_arrivals"   # name of the observed metric


def daily_counts(events: DataFrame, delay: str = "1 hour", user: str = "user_id") -> DataFrame:
    """Closed user-days with their event count; later rows are dropped (``late_events`` counts them)."""
    return (events.where(F.col("occurred_at").isNotNull()).observe(ARRIVED, F.count(F.lit(1)).alias("n"))
            .withWatermark("occurred_at", delay)
            .groupBy(F.window("occurred_at", "1 day").alias("w"), user)
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select(F.to_date("w.start").alias("date"), user, "n_events"))


def open_events(spark: SparkSession, checkpoint: str) -> int:
    """Events in user-days that are still open, from the state of the last batch."""
    if not exists(spark, f"{checkpoint}/state"):
        return 0
    rows = spark.read.format("statestore").load(checkpoint).select("value.*")
    return rows.agg(F.coalesce(F.sum(rows.columns[0]), F.lit(0))).first()[0]


def count_days(events: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", user: str = "user_id") -> DataFrame:
    """Run the daily counts; one row for the run: arrived, counted, open_before, open_after, late.

    Every event that arrived is counted in a closed day, waits in an open one, or came after its
    day was closed; late is what remains. Spark's own number of dropped rows counts rows after the
    partial aggregation, several events in one. Arrivals are observed in every batch, not only the last hundred.
    """
    spark = events.sparkSession
    before, counted_before = open_events(spark, checkpoint), _counted(spark, path)
    progress = run_available(daily_counts(events, delay, user), lambda b, i: write_once(b, path, i), checkpoint)
    arrived = sum(int(p.observedMetrics[ARRIVED]["n"]) for p in progress if ARRIVED in p.observedMetrics)
    after, counted = open_events(spark, checkpoint), _counted(spark, path) - counted_before
    return spark.createDataFrame([(arrived, counted, before, after, arrived + before - after - counted)],
                                 "arrived bigint, counted bigint, open_before bigint, open_after bigint, late bigint")


def _counted(spark: SparkSession, path: str) -> int:
    rows = read_batches(spark, path, "date date, n_events bigint")
    return 0 if rows is None else rows.agg(F.coalesce(F.sum("n_events"), F.lit(0))).first()[0]
