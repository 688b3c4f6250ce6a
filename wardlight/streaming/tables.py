"""Tables fed by micro-batches: one folder a batch, compacted runs behind a pointer, and an index of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.sources.files import _fs

FAN = 8              # runs of one level that are merged into one of the next
BUCKETS = 256        # folders that the keys of a run are dealt over
COMPACT_EVERY = 32   # batches


class Pointer:
    """The newest of numbered empty files in a folder.

    Making a file is atomic, so a reader sees the old value or the new one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _names(self) -> list[str]:
        fs, path = _fs(self.spark, self.folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def get(self) -> str | None:
        """The value (None before the first); it may hold neither slashes nor colons."""
        names = self._names()
        return names[-1].split("~", 1)[1] if names else None

    def move(self, value: str) -> None:
        names = self._names()
        number = int(names[-1].split("~", 1)[0]) + 1 if names else 0
        fs, path = _fs(self.spark, f"{self.folder}/{number:012d}~{value}")
        fs.createNewFile(path)
        for name in names[:-1]:   # the value before stays, for readers that just looked it up
            fs.delete(_fs(self.spark, f"{self.folder}/{name}")[1], False)


class BatchTable:
    """Rows of micro-batches: ``path/batch_id=N`` until compacted, then runs in ``path/_runs``.

    A batch that is written again replaces itself. ``compact`` merges finished batches into a run of level
    0, and whenever a level has ``FAN`` runs, these into one of the next level, so a row is rewritten
    once a level. Runs are partitioned by ``by``, the few batches after them are not. ``merge`` may
    drop rows that later ones replace. Folders are deleted one compaction after they were replaced,
    so readers that looked the pointer up before still find theirs.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | None = None, by: str | None = None, merge=None):
        self.spark, self.path, self.schema, self.by, self.merge = spark, path, schema, by, merge
        self.pointer = Pointer(spark, f"{path}/_pointer")

    def state(self) -> tuple[int, list[str]]:
        """(last compacted batch, names of the runs), -2 before any."""
        value = self.pointer.get()
        if value is None:
            return -2, []
        upto, *runs = value.split("+")
        return int(upto), runs

    def tail(self, upto: int) -> list[int]:
        """Batches after ``upto``."""
        numbers = (int(name[9:]) for name in self._names(self.path) if name.startswith("batch_id="))
        return sorted(n for n in numbers if n > upto)

    def folders(self, before: int | None = None, values=None) -> list[str]:
        """Folders that make up the table, without batches from ``before`` on; of runs those with one of the values of ``by``."""
        upto, names = self.state()
        runs = [f"{self.path}/_runs/{name}" for name in names]
        if values is not None:
            wanted = {f"{self.by}={value}" for value in values}
            runs = [f"{run}/{name}" for run in runs for name in self._names(run) if name in wanted]
        return runs + [f"{self.path}/batch_id={n}" for n in self.tail(upto) if before is None or n < before]

    def _names(self, folder: str) -> list[str]:
        fs, path = _fs(self.spark, folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def load(self, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        reader = self.spark.read.option("recursiveFileLookup", "true")
        return (reader.schema(self.schema) if self.schema else reader).parquet(*folders)

    def read(self) -> DataFrame | None:
        """All rows, merged; None before the first batch."""
        rows = self.load(self.folders())
        return rows if rows is None or self.merge is None else self.merge(rows)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def _run(self, name: str, folders: list[str], prepare) -> str:
        rows = self.load(folders)
        rows = prepare(rows if self.merge is None else self.merge(rows))
        writer = (rows.repartition(self.by) if self.by else rows).write.mode("overwrite")
        (writer.partitionBy(self.by) if self.by else writer).parquet(f"{self.path}/_runs/{name}")
        return name

    def compact(self, upto: int, prepare=lambda rows: rows) -> None:
        """Merge batches up to ``upto``; a batch that may still be replayed must not be among them.

        ``prepare`` adds the column ``by``, which files do not hold.
        """
        before, runs = self.state()
        batches = [n for n in self.tail(before) if n <= upto]
        if not batches:
            return
        new = [*runs, self._run(f"0-{upto}", [f"{self.path}/batch_id={n}" for n in batches], prepare)]
        level = 0
        while len(full := [run for run in new if run.startswith(f"{level}-")]) >= FAN:
            level += 1
            new = [run for run in new if run not in full] + [self._run(f"{level}-{upto}", [f"{self.path}/_runs/{r}" for r in full], prepare)]
        fs, root = _fs(self.spark, f"{self.path}/_runs")
        stale = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in {*runs, *new}]
        self.pointer.move("+".join([str(upto), *new]))
        for path in [*stale, *(_fs(self.spark, f"{self.path}/batch_id={n}")[1] for n in self.tail(-2) if n <= before)]:
            fs.delete(path, True)


class KeyIndex:
    """Keys stored by earlier batches, in buckets of their hash; a batch reads its own buckets only.

    Null keys are kept apart from each other, as in a join. Keys may have any type that hashes.
    """

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], buckets: int = BUCKETS,
                 compact_every: int = COMPACT_EVERY):
        self.spark, self.keys, self.buckets, self.compact_every = spark, keys, buckets, compact_every
        self.table = BatchTable(spark, path, by="_bucket")

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def unseen(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """Rows whose key no earlier batch stored. A replayed batch does not meet its own first attempt."""
        touched = None
        if self.table.state()[1]:
            touched = [r[0] for r in self._with_bucket(rows.select(*self.keys)).select("_bucket").distinct().collect()]
        known = self._stored(self.table.folders(batch_id, touched), rows)
        if known is None:
            return rows
        return rows.join(known.where(F.col("_batch") < batch_id).select(*self.keys), list(self.keys), "left_anti")

    def _stored(self, folders: list[str], rows: DataFrame) -> DataFrame | None:
        self.table.schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in self.keys) + ", _batch bigint"
        return self.table.load(folders)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store the keys of a batch; every so many batches the finished ones are compacted."""
        self.table.append(rows.select(*self.keys, F.lit(batch_id).cast("bigint").alias("_batch")), batch_id)
        if batch_id - max(self.table.state()[0], -1) > self.compact_every:
            self._stored([], rows)   # sets the schema
            self.table.compact(batch_id - 1, self._with_bucket)   # this batch may be replayed

    def adopt(self, stored: DataFrame | None, batch_id: int) -> None:
        """Index the keys of a table filled before there was an index: rows with ``batch_id`` below the given one."""
        if stored is not None and not self.table.folders():
            old = stored.where(F.col("batch_id") < batch_id)
            self.table.append(old.select(*self.keys, F.col("batch_id").cast("bigint").alias("_batch")), -1)   # before all batches
