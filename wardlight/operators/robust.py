"""Median/MAD baselines per user and department."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.functions.text import catalogue_key, domain_token
from wardlight.operators.ranking import median_by

# SQL over a sorted array of numbers, and over sorted cells struct(v, n).
_MEDIAN = ("(element_at({a}, CAST((size({a}) + 1) DIV 2 AS INT)) + "
           "element_at({a}, CAST(size({a}) DIV 2 + 1 AS INT))) / 2D")
_AT = ("aggregate({c}, named_struct('seen', 0L, 'v', CAST(NULL AS DOUBLE)), (acc, x) -> named_struct("
       "'seen', acc.seen + x.n, 'v', CASE WHEN acc.v IS NULL AND {p} < acc.seen + x.n THEN "
       "CAST(x.v AS DOUBLE) ELSE acc.v END), acc -> acc.v)")


def sorted_median(array: str) -> str:
    """SQL: median of a sorted, non-empty numeric array column."""
    return _MEDIAN.format(a=array)


def cells_median(cells: str, total: str) -> str:
    """SQL: median of sorted cells struct(v, n) holding ``total`` values."""
    low = _AT.format(c=cells, p=f"({total} - 1) DIV 2")
    high = _AT.format(c=cells, p=f"{total} DIV 2")
    return f"(({low}) + ({high})) / 2D"


def dial_minutes(a: str, b: str) -> str:
    """SQL: minutes apart on a 24-hour dial."""
    return f"abs(pmod({a} - {b} + 720, 1440) - 720)"


def user_days(events: DataFrame) -> DataFrame:
    """Bytes and last department per (user, day).

    Departments are grouping keys first, so the pass over the events aggregates
    numbers only.
    """
    first = events.groupBy("user_id", F.to_date("occurred_at").alias("day"), "department").agg(
        F.sum("bytes_transferred").alias("bytes"), F.max(F.unix_micros("occurred_at")).alias("last_us"))
    return first.groupBy("user_id", "day").agg(
        F.sum("bytes").alias("bytes"), F.max("last_us").alias("last_us"),
        F.max_by("department", F.struct("last_us", "department")).alias("department"))


def login_cells(events: DataFrame) -> DataFrame:
    """Login histogram: at most 1,440 cells per user, whatever the number of logins."""
    minute = F.hour("occurred_at") * 60 + F.minute("occurred_at")
    return (events.where(F.col("event_type") == "login")
            .groupBy("user_id", minute.cast("long").alias("minute"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("occurred_at")).alias("first_us")))


def login_pattern(cells: DataFrame) -> DataFrame:
    """The login minute nearest to all others on the dial, and its spread.

    Works on the bounded histogram inside one row. Ties go to the minute seen first.
    """
    grouped = cells.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("minute", "n", "first_us"))).alias("cells"),
        F.sum("n").alias("login_samples"))
    return with_login_spread(grouped, "cells", "login_samples").select(
        "user_id", "login_samples", "login_hour_centre", "login_hour_scale")


def central_minute(cells: str) -> str:
    """SQL: the minute of cells struct(minute, n, first_us) nearest to all others on the dial; ties go to the one seen first.

    Round the dial the summed distance is a broken line: it turns up by 2 n at each cell and down by
    2 n opposite to it. One pass over the sorted turns carries distance and slope, so the work is
    in proportion to the cells.
    """
    turns = (f"sort_array(concat(transform({cells}, x -> named_struct('at', x.minute, 'turn', 2 * x.n, 'first_us', x.first_us)), "
             f"transform({cells}, x -> named_struct('at', pmod(x.minute + 720, 1440), 'turn', -2 * x.n, "
             "'first_us', CAST(NULL AS BIGINT)))))")
    cost = f"aggregate({cells}, 0L, (acc, x) -> acc + x.n * {dial_minutes('x.minute', '0')})"
    slope = f"aggregate({cells}, 0L, (acc, x) -> acc + CASE WHEN pmod(-x.minute, 1440) < 720 THEN x.n ELSE -x.n END)"
    best = "CAST(NULL AS STRUCT<cost: BIGINT, first_us: BIGINT, minute: BIGINT>)"
    here = "s.cost + s.slope * (x.at - s.at)"
    return (f"aggregate({turns}, named_struct('at', 0L, 'cost', {cost}, 'slope', {slope}, 'best', {best}), "
            f"(s, x) -> named_struct('at', x.at, 'cost', {here}, 'slope', s.slope + CASE WHEN x.at > 0 THEN x.turn ELSE 0L END, "
            f"'best', CASE WHEN x.first_us IS NULL THEN s.best ELSE least(s.best, named_struct("
            f"'cost', {here}, 'first_us', x.first_us, 'minute', x.at)) END), s -> s.best.minute)")


def with_login_spread(df: DataFrame, cells: str, samples: str) -> DataFrame:
    """Adds centre and scale in hours from a cells column struct(minute, n, first_us)."""
    step = df.withColumn("_centre", F.expr(central_minute(cells)))
    step = step.withColumn("_dist", F.expr(
        f"sort_array(transform({cells}, x -> named_struct('v', "
        f"{dial_minutes('x.minute', '_centre')}, 'n', x.n)))"))
    step = step.withColumn("_mid", F.expr(cells_median("_dist", samples)))
    step = step.withColumn("_off", F.expr(
        "sort_array(transform(_dist, x -> named_struct('v', abs(x.v - _mid), 'n', x.n)))"))
    scale = F.expr(
        f"CASE WHEN {samples} IS NULL OR {samples} = 0 THEN NULL WHEN {samples} < 2 THEN 1D "
        f"ELSE greatest({fv.MAD_TO_SIGMA}D * ({cells_median('_off', samples)}) / 60D, 1D) END")
    return (step.withColumn("login_hour_centre", F.col("_centre") / 60.0)
            .withColumn("login_hour_scale", scale).drop("_centre", "_dist", "_mid", "_off"))


def with_volume_spread(df: DataFrame, volumes: str) -> DataFrame:
    """Adds median and scaled MAD of an array of daily volumes (empty counts as [0])."""
    step = df.withColumn("_vol", F.expr(
        f"CASE WHEN size({volumes}) > 0 THEN sort_array(transform({volumes}, v -> CAST(v AS DOUBLE))) "
        "ELSE array(0D) END"))
    step = step.withColumn("daily_volume_median", F.expr(sorted_median("_vol")))
    step = step.withColumn("_gap", F.expr("sort_array(transform(_vol, v -> abs(v - daily_volume_median)))"))
    return step.withColumn("daily_volume_scale", F.expr(
        f"CASE WHEN size(_vol) < 2 THEN 1D ELSE greatest({fv.MAD_TO_SIGMA}D * ({sorted_median('_gap')}), 1D) END"
    )).drop("_vol", "_gap")


def robust_user_baselines(events: DataFrame) -> DataFrame:
    """Volume median/MAD, login centre/spread, days and last department.

    Per user one entry per calendar day and at most 1,440 login cells meet in a
    row; the raw events never do.
    """
    days = user_days(events).groupBy("user_id").agg(
        F.max_by("department", F.struct("last_us", "department")).alias("department"),
        F.collect_list("bytes").alias("volumes"), F.count(F.lit(1)).alias("sample_days"))
    volume = with_volume_spread(days, "volumes").drop("volumes")
    return (volume.join(login_pattern(login_cells(events)), "user_id", "left")
            .withColumn("login_samples", F.coalesce("login_samples", F.lit(0))))


def known_domains(events: DataFrame, key: str) -> DataFrame:
    """The domain tokens of each user, one row per pair.

    Kept as rows, not as one array per user: the set has no bound.
    """
    pairs = (events.where(F.col("domain").isNotNull())
             .select("user_id", catalogue_key("domain").alias("domain"))
             .where(F.col("domain") != "").distinct())
    return pairs.select("user_id", domain_token("domain", key).alias("domain_token")).distinct()


def known_apps(events: DataFrame, apps: DataFrame) -> DataFrame:
    """Catalogued applications of each user; ``apps`` maps domain to name."""
    pairs = events.where(F.col("domain").isNotNull()).select("user_id", "domain").distinct()
    return pairs.join(apps.select("domain", F.col("name").alias("app_name")), "domain").select(
        "user_id", "app_name").distinct()


def peer_baselines(users: DataFrame) -> DataFrame:
    """A10: per department, median and MAD of the users' daily medians.

    A department may hold any number of users: the medians come from value
    counts, not from a collected group.
    """
    volumes = users.where(F.col("department").isNotNull()).select("department", "daily_volume_median")
    middle = median_by(volumes, "daily_volume_median", ["department"], "median")
    gaps = volumes.join(middle, "department").select(
        "department", F.abs(F.col("daily_volume_median") - F.col("median")).alias("gap"))
    mad = median_by(gaps, "gap", ["department"], "mad").select("department", "mad")
    return middle.join(mad, "department").select(
        "department", F.col("median").alias("daily_volume_median"),
        F.when(F.col("n_total") < 2, 1.0).otherwise(
            F.greatest(F.col("mad") * fv.MAD_TO_SIGMA, F.lit(1.0))).alias("daily_volume_scale"),
        F.col("n_total").alias("cohort_size"))
