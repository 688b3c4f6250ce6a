"""Operator 1: repeated word windows by difference-cover anchors.

Positions p with p mod 13 in {0, 1, 3, 9} are anchors: whatever two positions a
match has in two documents, one of 13 neighbouring offsets makes both of them anchors.
A match of 20 words therefore contains a shared anchor window of 8 words. Only anchor
windows that occur twice are extended to the 20-word windows around them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm import textscan
from wardlight.llm.stored import discard, store

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)     # every difference mod 13 is one of two of these
CHUNK = 1_000_000                    # rows combined before they are dealt out
_WORD = re.compile("[^ \t\n\v\f\r]+")
_ROW = "id bigint, place bigint, hash bigint, check int, known boolean"


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, id (null ids lowest), turn (0, 1, ... among rows that repeat an id, by text), text."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    again = source.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    if again.isEmpty():
        return source.select("doc_id", "id", F.lit(0).alias("turn"), "text")
    from pyspark.sql import Window

    turn = F.row_number().over(Window.partitionBy("id").orderBy("text")) - 1
    return source.select("doc_id", "id", turn.alias("turn"), "text")


class _Combiner:
    """Rows of one task, combined by hash: of equal rows the first is sent, the rest is known to repeat."""

    def __init__(self, first_too: bool):
        self.first_too, self.parts, self.rows = first_too, [], 0

    def add(self, ids, places, hashes, checks) -> Iterator[pa.RecordBatch]:
        self.parts.append((ids, places, hashes, checks))
        self.rows += len(ids)
        if self.rows >= CHUNK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        ids, places, hashes, checks = map(np.concatenate, zip(*self.parts, strict=True))
        self.parts, self.rows = [], 0
        order = np.lexsort((places, ids, checks, hashes))
        ids, places, hashes, checks = ids[order], places[order], hashes[order], checks[order]
        same = (hashes[1:] == hashes[:-1]) & (checks[1:] == checks[:-1])
        known = np.append([False], same)
        if self.first_too:   # a row that repeats makes the first one a repeat as well
            known[:-1] |= same
        sent = ~np.append([False], same) | known
        out = [ids, places, hashes.view(np.int64), checks, known]
        if self.first_too:   # the first of equal rows still meets those of other tasks
            first = np.flatnonzero(~np.append([False], same) & known)
            out = [np.concatenate([x, x[first]]) for x in out]
            out[4][len(ids):] = False
            sent = np.ones(len(out[0]), bool)
        out = [x[sent] for x in out]
        for begin in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[begin:begin + 100_000]) for x in out],
                                             names=["id", "place", "hash", "check", "known"])


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows of one hash in one partition, sorted; known repeats go anywhere."""
    key = F.when(F.col("known"), F.xxhash64("id", "place")).otherwise(F.col("hash"))
    return rows.repartition(parts, key).sortWithinPartitions("known", "hash", "check", "id", "place")


def _repeats(first_too: bool):
    """A pass over dealt rows that gives those whose hash occurs before, or also the first of them."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids, places, hashes, checks, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            if not len(ids):
                continue
            same = np.zeros(len(ids), bool)
            same[1:] = (hashes[1:] == hashes[:-1]) & (checks[1:] == checks[:-1]) & ~known[1:]
            if last is not None and not known[0]:
                same[0] = hashes[0] == last[2] and checks[0] == last[3]
            keep = same | known
            if first_too:
                keep[:-1] |= same[1:]
                if same[0]:   # may be given twice; positions are a set
                    yield pa.RecordBatch.from_pydict({"id": pa.array([last[0]], pa.int64()),
                                                      "place": pa.array([last[1]], pa.int64())})
            last = None if known[-1] else (int(ids[-1]), int(places[-1]), hashes[-1], checks[-1])
            yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(places[keep])], names=["id", "place"])

    return scan


def _by_document(found: DataFrame, name: str) -> DataFrame:
    """id, turn and the sorted word positions of each document."""
    rows = found.groupBy("id", F.shiftright("place", 40).cast("int").alias("turn")).agg(
        F.collect_set((F.col("place") % F.lit(1 << 40)).cast("int")).alias("places"))
    return store(found.sparkSession, rows, name)


def repeated_windows(source: DataFrame, window: int = WINDOW, parts: int | None = None) -> DataFrame:
    """id, turn, places: starts of windows whose words also start a window earlier.

    source: id, turn, text as ``_numbered`` gives them.
    """
    parts = parts or int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = window - PERIOD + 1
    if width < 1:
        raise ValueError(f"a window has at least {PERIOD} words")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = _Combiner(first_too=True)
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        for batch in batches:
            ids, turns = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            for first, hashes, bounds in textscan.hashed_rows(batch.column(2)):
                where, rows = textscan.window_rows(bounds, width)
                place = where - bounds[:-1][rows]
                pick = cover[place % PERIOD] & (np.diff(bounds)[rows] >= window)
                where, rows, place = where[pick], rows[pick] + first, place[pick]
                rolled = textscan.rolling(hashes, width)[where] if len(where) else np.zeros(0, np.uint64)
                yield from combiner.add(ids[rows], place + (turns[rows] << 40), rolled,
                                        np.zeros(len(rows), np.int32))
        yield from combiner.flush()

    found = source.select("id", "turn", "text").mapInArrow(anchors, _ROW)
    shared = _by_document(_dealt(found, parts).mapInArrow(_repeats(True), "id bigint, place bigint"), "anchors")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = _Combiner(first_too=False)
        for batch in batches:
            ids, turns = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            places = batch.column(3)
            for first, hashes, bounds in textscan.hashed_rows(batch.column(2)):
                n = len(bounds) - 1
                mine = places.slice(first, n)
                at = mine.flatten().to_numpy().astype(np.int64)
                rows = np.repeat(np.arange(n), pa.compute.list_value_length(mine).to_numpy())
                # A window that starts up to PERIOD - 1 words before a shared anchor contains it.
                change = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(change, bounds[:-1][rows] + np.maximum(at - PERIOD + 1, 0), 1)
                np.add.at(change, bounds[:-1][rows] + at + 1, -1)
                where, rows = textscan.window_rows(bounds, window)
                pick = np.cumsum(change)[where] > 0
                where, rows = where[pick], rows[pick]
                rolled = textscan.rolling(hashes, window)[where] if len(where) else np.zeros(0, np.uint64)
                second = textscan.rolling(textscan.mix(hashes + np.uint64(1)), window)[where] if len(where) else rolled
                check = (second & np.uint64(0x7FFFFFFF)).astype(np.int32)
                yield from combiner.add(ids[rows + first], where - bounds[:-1][rows] + (turns[rows + first] << 40),
                                        rolled, check)
        yield from combiner.flush()

    joined = source.join(shared, ["id", "turn"]).select("id", "turn", "text", "places")
    found = _dealt(joined.mapInArrow(windows, _ROW), parts)
    repeated = _by_document(found.mapInArrow(_repeats(False), "id bigint, place bigint"), "windows")
    discard(shared)
    return repeated


def remove_repeats(docs: DataFrame, window: int = WINDOW, parts: int | None = None, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (the words left, one space between).

    Words are runs of anything but space and \\t \\n \\v \\f \\r. A word goes if a window of
    ``window`` words covers it whose word sequence also starts earlier: in a smaller id,
    or before in the same document. Windows are judged on the input. A null text has no
    words, and a text with fewer than ``window`` loses none. Null ids come first. Rows
    that repeat an id are told apart and ordered by their text. Extra columns are not
    read; an empty table gives an empty result. Window equality is that of 95-bit hashes.

    Anchors and windows are dealt by hash after each task has combined its own, so a
    passage shared by a third of all documents is one row per task.
    """
    source = _numbered(docs, id_col, text_col)
    found = repeated_windows(source, window, parts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                totals, gone, kept = [], [], []
                for text, starts in zip(part.column(1).to_pylist(), part.column(2), strict=True):
                    words = _WORD.findall(text or "")
                    totals.append(len(words))
                    if starts.is_valid:
                        change = np.zeros(len(words) + window + 1, np.int64)
                        at = starts.values.to_numpy()
                        change[at] += 1
                        change[at + window] -= 1
                        keep = np.cumsum(change)[:len(words)] == 0
                        words = list(compress(words, keep.tolist()))
                    gone.append(totals[-1] - len(words))
                    kept.append(" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    joined = source.join(found, ["id", "turn"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept string").withColumnRenamed(
        "doc_id", id_col)
