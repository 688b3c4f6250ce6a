"""Table, file and alert outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight import fixed_values as fv
from wardlight.operators.quality import good_rows, quarantine_rows
from wardlight.session import materialize


def write_normalized(normalized: DataFrame, events_path: str, quarantine_path: str) -> None:
    """K1: accepted events by day, rejected ids with the reason.

    The checked rows are stored first, so the checks run once for the two outputs.
    """
    normalized = materialize(normalized.sparkSession, normalized, "checked")
    good = good_rows(normalized).withColumn("event_date", F.to_date("timestamp"))
    # Rows of a day meet before they are written: files by size of the day, not tasks times days.
    good.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").parquet(events_path)
    quarantine_rows(normalized).write.mode("append").json(quarantine_path)


def write_table(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite") -> None:
    """K2/K9: a result table, partitioned by day where it has one.

    Rows of a day are spread over tasks by size, so a large day gives several files.
    """
    if by is None:
        df.write.mode(mode).parquet(path)
    else:
        df.hint("rebalance", by).write.mode(mode).partitionBy(by).parquet(path)


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A stored table, only the named columns."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_alert_json(alerts: DataFrame, path: str) -> None:
    """K3."""
    alerts.write.mode("overwrite").json(path)


def write_alert_csv(alerts: DataFrame, path: str) -> None:
    """K4: the 11 export columns with a header."""
    alerts.select(*fv.ALERT_CSV_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def append_scores(scores: DataFrame, path: str) -> None:
    """K5: score rows are appended; readers take the newest per event (``latest_by``)."""
    scores.write.mode("append").parquet(path)


def merge_baselines(new: DataFrame, previous: DataFrame | None, key: str) -> DataFrame:
    """K6: the new baselines and the previous ones of keys outside the window."""
    if previous is None:
        return new
    kept = previous.join(new.select(key), key, "left_anti")
    return new.unionByName(kept.select(*new.columns))


def write_baselines(new: DataFrame, root: str, version: str, key: str,
                    previous: DataFrame | None = None) -> str:
    """K6: a new versioned table; the version read stays untouched while it is written."""
    path = f"{root}/version={version}"
    merge_baselines(new, previous, key).write.mode("overwrite").parquet(path)
    return path
