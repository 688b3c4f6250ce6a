"""Baselines as they stood at each event: the trailing window before it.

The window is anchored on the evaluated event. Where the reference day is the
newest event of a stored history, the two agree as soon as that history reaches
up to the event. Nothing here keeps a user's whole history in one task: rows
are cut by day, hour or minute, and what crosses a cut is a small total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.text import domain_token
from wardlight.operators import detect
from wardlight.operators.ranking import running_before
from wardlight.operators.robust import with_login_spread, with_volume_spread

KEYS = ("tenant_id", "user_id")
DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def last_seen_before(events: DataFrame, token: str, keys=KEYS, bucket_us: int = DAY_US,
                     out: str = "last_seen_us") -> DataFrame:
    """When the user last showed the same token strictly before the event.

    Inside a time bucket a running maximum gives it; else the newest bucket
    before. Rows without a token spread by event id and get NULL.
    """
    keys = list(keys)
    us = F.unix_micros("occurred_at")
    staged = events.withColumn("_us", us).withColumn(
        "_b", F.when(F.col(token).isNull(), F.xxhash64("event_id")).otherwise(F.floor(us / bucket_us)))
    per_bucket = staged.where(F.col(token).isNotNull()).groupBy(*keys, token, "_b").agg(
        F.max("_us").alias("_newest"))
    earlier = per_bucket.select(*keys, token, "_b", F.lag("_newest").over(
        Window.partitionBy(*keys, token).orderBy("_b")).alias("_earlier"))
    inside = (Window.partitionBy(*keys, token, "_b").orderBy("_us")
              .rangeBetween(Window.unboundedPreceding, -1))
    running = F.when(F.col(token).isNotNull(), F.max("_us").over(inside))
    return (staged.withColumn("_in", running).join(earlier, [*keys, token, "_b"], "left")
            .select(*events.columns, F.coalesce("_in", "_earlier").alias(out)))


def within_window(last_seen_us: str = "last_seen_us", days: int = fv.BASELINE_WINDOW_DAYS):
    """Whether a last sighting lies in the window before the event."""
    return F.coalesce(F.col(last_seen_us) >= F.unix_micros("occurred_at") - days * DAY_US, F.lit(False))


def _with_shifted(events: DataFrame, columns: list[str], days: int) -> DataFrame:
    """The rows, and each row again ``days`` later, so that both window ends move together.

    ``_kind`` is 0 for the rows and 1 for the copies that leave the window.
    """
    twice = F.array(
        F.struct(F.col("_us").alias("us"), F.col("_day").alias("day"), F.lit(0).alias("kind")),
        F.struct((F.col("_us") + days * DAY_US).alias("us"), (F.col("_day") + days).alias("day"),
                 F.lit(1).alias("kind")))
    return events.select(*columns, F.explode(twice).alias("_x")).select(
        *columns, F.col("_x.us").alias("_us"), F.col("_x.day").alias("_day"), F.col("_x.kind").alias("_kind"))


def trailing_volume(events: DataFrame, keys=KEYS, days: int = fv.BASELINE_WINDOW_DAYS) -> DataFrame:
    """Per event the days, median and spread of the daily bytes in the window before it.

    Whole days come from per-day totals; the two days the window cuts come from
    running sums up to the event.
    """
    keys = list(keys)
    timed = events.withColumn("_us", F.unix_micros("occurred_at")).withColumn(
        "_day", F.unix_date(F.to_date("occurred_at")).cast("long"))
    own = F.col("_kind") == 0
    moved = F.col("bytes_transferred").cast("long")
    both = _with_shifted(timed, [*keys, "event_id", "bytes_transferred"], days)
    cuts = running_before(both, [*keys, "_day"], "_us", HOUR_US, {
        "cur_sum": F.when(own, moved).otherwise(0), "cur_n": own.cast("int"),
        "old_sum": F.when(~own, moved).otherwise(0), "old_n": (~own).cast("int")}).where(own)
    totals = timed.groupBy(*keys, "_day").agg(F.sum(moved).alias("total"), F.count(F.lit(1)).alias("n"))
    frame = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-days, -1)
    past = totals.select(*keys, "_day", F.collect_list(
        F.struct(F.col("_day").alias("day"), "total", "n")).over(frame).alias("_past"))
    joined = cuts.join(past, [*keys, "_day"])
    values = F.expr(
        f"concat(transform(filter(_past, p -> p.day > _day - {days}), p -> p.total), "
        f"transform(filter(_past, p -> p.day = _day - {days} AND p.n > old_n), p -> p.total - old_sum), "
        "CASE WHEN cur_n > 0 THEN array(cur_sum) ELSE CAST(array() AS ARRAY<BIGINT>) END)")
    spread = with_volume_spread(joined.withColumn("_values", values), "_values")
    return spread.select("event_id", F.size("_values").alias("sample_days"),
                         "daily_volume_median", "daily_volume_scale")


def trailing_logins(events: DataFrame, keys=KEYS, days: int = fv.BASELINE_WINDOW_DAYS) -> DataFrame:
    """Per login event the number, centre and spread of the logins in the window before it.

    Logins are held as minute histograms of the dial, at most 1,440 cells per user and day: whole
    days are added up once per day, not per event. Of the two days the window cuts, the minutes before
    or after the event's minute count whole; its own minute is counted row by row.
    """
    keys = list(keys)
    minute = (F.hour("occurred_at") * 60 + F.minute("occurred_at")).cast("long")
    logins = (events.where(F.col("event_type") == "login")
              .select(*keys, "event_id", F.unix_micros("occurred_at").alias("_us"),
                      F.unix_date(F.to_date("occurred_at")).cast("long").alias("_day"), minute.alias("_m")))
    cells = logins.groupBy(*keys, "_day", "_m").agg(
        F.count(F.lit(1)).alias("n"), F.min("_us").alias("first_us"))
    age = F.col("_x") - F.col("_day")
    parts = {"cur": age == 0, "full": age.between(1, days - 1), "old": age == days}
    sums = [agg for name, at in parts.items() for agg in (
        F.coalesce(F.sum(F.when(at, F.col("n"))), F.lit(0)).alias(name), F.min(F.when(at, F.col("first_us"))).alias(f"{name}_us"))]
    merged = (cells.select(*keys, "_day", "_m", "n", "first_us", F.explode(F.sequence(F.col("_day"), F.col("_day") + days)).alias("_x"))
              .groupBy(*keys, F.col("_x").alias("_day"), "_m").agg(*sums))
    past = merged.groupBy(*keys, "_day").agg(
        F.max("cur").alias("_any"), F.collect_list(F.struct(F.col("_m").alias("minute"), *(
            c for name in parts for c in (name, f"{name}_us")))).alias("_past")).where(F.col("_any") > 0)
    # One row per minute with logins, so that the logins of one user and day meet their histogram in many tasks.
    past = past.select(*keys, "_day", F.sort_array("_past").alias("_past")).select(
        "*", F.explode(F.expr("transform(filter(_past, c -> c.cur > 0), c -> c.minute)")).alias("_m"))

    own = F.col("_kind") == 0
    both = _with_shifted(logins, [*keys, "event_id", "_m"], days)
    by_minute = Window.partitionBy(*keys, "_day", "_m").orderBy("_us")
    before = by_minute.rangeBetween(Window.unboundedPreceding, -1)
    after = by_minute.rangeBetween(0, Window.unboundedFollowing)
    cut = both.select(
        *keys, "event_id", "_day", "_m", "_kind",
        F.coalesce(F.sum(own.cast("long")).over(before), F.lit(0)).alias("cur_n"),
        F.min(F.when(own, F.col("_us"))).over(before).alias("cur_first"),
        F.coalesce(F.sum((~own).cast("long")).over(after), F.lit(0)).alias("old_n"),
        (F.min(F.when(~own, F.col("_us"))).over(after) - days * DAY_US).alias("old_first")).where(own)
    counted = ("c.full + CASE WHEN c.minute < _m THEN c.cur WHEN c.minute > _m THEN c.old ELSE cur_n + old_n END")
    first = ("least(c.full_us, CASE WHEN c.minute < _m THEN c.cur_us WHEN c.minute > _m THEN c.old_us "
             "ELSE least(cur_first, old_first) END)")
    gathered = F.expr(f"filter(transform(_past, c -> named_struct('minute', c.minute, 'n', {counted}, 'first_us', {first})), c -> c.n > 0)")
    rows = cut.join(past, [*keys, "_day", "_m"]).withColumn("_cells", gathered)
    rows = rows.withColumn("login_samples", F.expr("aggregate(_cells, 0L, (acc, c) -> acc + c.n)"))
    return with_login_spread(rows, "_cells", "login_samples").select(
        "event_id", "login_samples", "login_hour_centre", "login_hour_scale")


def trailing_baselines(events: DataFrame, key: str, keys=KEYS,
                       days: int = fv.BASELINE_WINDOW_DAYS) -> DataFrame:
    """Every event with its own trailing baseline, in the shape the detectors read."""
    tokened = events.withColumn("domain_token", domain_token("domain", key))
    seen = last_seen_before(tokened, "domain_token", keys)
    return (seen.join(trailing_volume(events, keys, days), "event_id", "left")
            .join(trailing_logins(events, keys, days), "event_id", "left")
            .withColumn("has_baseline", F.coalesce(F.col("sample_days") > 0, F.lit(False)))
            .withColumn("domain_known", F.when(within_window("last_seen_us", days), True)))


def first_uses(events: DataFrame, token: str, keys=KEYS, days: int = fv.BASELINE_WINDOW_DAYS) -> DataFrame:
    """Events whose token the user did not show in the window before."""
    seen = last_seen_before(events, token, keys)
    return seen.where(F.col(token).isNotNull() & ~within_window("last_seen_us", days)).drop("last_seen_us")


def evaluate(events: DataFrame, peers: DataFrame, key: str, keys=KEYS,
             days: int = fv.BASELINE_WINDOW_DAYS) -> DataFrame:
    """The package rule set on all events at once.

    ``events`` has an ``app`` struct (see ``catalogue.with_app``). Peer figures
    are those of the stored department baselines.
    """
    apps = last_seen_before(events.withColumn("_app", F.col("app.name")), "_app", keys, out="_app_us")
    known = apps.select("event_id", within_window("_app_us", days).alias("app_known"))
    cohort = peers.select("department", F.col("daily_volume_median").alias("peer_median"),
                          F.col("daily_volume_scale").alias("peer_scale"), "cohort_size")
    rows = (trailing_baselines(events, key, keys, days).join(known, "event_id", "left")
            .join(cohort, "department", "left"))
    columns = [*detect.policy_signals(), *detect.behaviour_signals("package")]
    if "detectors" in events.columns:
        columns.append(detect.sensitive_signal())
    return detect.with_signals(rows, columns)
