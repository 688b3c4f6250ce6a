"""Intermediate tables in the shared folder, and their removal when they have been read."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from wardlight.session import scratch_path


def store(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back; shuffle files it needed are let go.

    Spark drops shuffle files once the driver has collected the frames that made them,
    which a quiet driver may not do for long; hence the call.
    """
    path = scratch_path(spark, name)
    df.write.parquet(path)
    for _ in range(2):   # the listeners of the finished write may still hold its plan the first time
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
