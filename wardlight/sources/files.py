"""File listing and headers through Hadoop, so that any shared file system works."""

from __future__ import annotations

import csv

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def list_files(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Entries directly below ``folder`` with the suffix, by name (a CSV may be a part folder)."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(p)
                  if s.getPath().getName().lower().endswith(suffix))


def existing_file(spark: SparkSession, folder: str, name: str) -> str | None:
    """Path of the entry whose name matches in any case, or None."""
    for path in list_files(spark, folder, name.lower()):
        if path.rsplit("/", 1)[-1].lower() == name.lower():
            return path
    return None


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names in the first line."""
    first = spark.read.text(path).limit(1).collect()
    return next(csv.reader([first[0][0]])) if first else []
