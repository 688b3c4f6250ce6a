"""Operator 8: benchmark decontamination by rare seeds and local alignment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm import textscan

SEED = 3                 # words of a seed
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
THRESHOLD = 0.5          # alignment score by the item's own, at least
SHARE = 0.01             # a seed in that share of texts beyond 4 x the item's median is still rare
BLOCK_WORDS = 1_000_000  # words of test items that go to the workers at once (8 MB)


def _items(benchmark: DataFrame, id_col: str, text_col: str, block: int, blocks: int) -> list[tuple[int, np.ndarray]]:
    part = benchmark.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = part.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).distinct().orderBy("id", "text").collect()
    found = []
    for row in rows:
        for _, hashes, _ in textscan.hashed_rows(pa.array([row.text]), plain=True):
            if len(hashes):
                found.append((row.id, hashes))
    return found


def _seeds(items: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted seed hashes with item number and position; a shorter item is one seed."""
    hashes, item, place = [], [], []
    for number, (_, words) in enumerate(items):
        rolled = textscan.rolling(words, min(SEED, len(words)))
        hashes.append(rolled)
        item.append(np.full(len(rolled), number))
        place.append(np.arange(len(rolled)))
    hashes, item, place = map(np.concatenate, (hashes, item, place))
    order = np.lexsort((place, item, hashes))
    return hashes[order], item[order], place[order]


def _hits(words: np.ndarray, bounds: np.ndarray, known: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, places in the slice and numbers of the known seeds of ``width`` words."""
    places, rows = textscan.window_rows(bounds, width)
    rolled = textscan.rolling(words, width)[places] if len(places) else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
    hit = known[at] == rolled
    return rows[hit], places[hit], at[hit]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """Best local alignment of two word sequences: its score and its end in the passage."""
    before, best, end = np.zeros(len(passage) + 1), 0.0, 0
    slope = -GAP * np.arange(len(passage) + 1)
    for word in item:
        row = np.maximum(before + GAP, 0.0)
        row[1:] = np.maximum(row[1:], before[:-1] + np.where(passage == word, MATCH, MISMATCH))
        before = np.maximum.accumulate(row + slope) - slope
        top = int(before.argmax())
        if before[top] > best:
            best, end = float(before[top]), top
    return best, end


def _passages(begins: np.ndarray, size: int, words: int, threshold: float) -> list[tuple[int, int, int]]:
    """Stretches of a document that may hold an item, with the seeds in each.

    begins: where the item would begin by each seed. Seeds whose stretches overlap share one. An alignment
    that reaches the threshold has room for so many words that the item lacks, and no more.
    """
    slack = math.ceil((1 - threshold) * MATCH * size / -GAP) + SEED
    begins = np.sort(begins)
    groups = np.split(begins, np.flatnonzero(np.diff(begins) > slack) + 1)
    return [(max(0, int(g[0]) - slack), min(words, int(g[-1]) + size + slack), len(g)) for g in groups]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS,
                 id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """A row per document and test item that it holds: doc_id, item_id, score, start_word, end_word, n_seeds.

    Words are compared in lower case without punctuation. Seeds are the item's runs of
    SEED words, without those that occur more often than 4 times the median of the item's seeds that occur
    at all plus SHARE of the number of texts; frequencies are counted over all documents. One kept seed is enough for a passage to be aligned. Around the seeds a document
    shares with an item, Smith-Waterman alignment gives the score, 1 for a whole copy.
    The best passage is kept per pair; ``threshold`` decides. Null or empty texts, items
    without words and null item ids match nothing; items with one id are separate texts under
    that id; of equally good passages the first counts; rows that repeat a document are reported each. Null document ids stay null.
    Extra columns are not read; an empty table on either side gives an empty result.

    Test items go to the workers in blocks of about ``block_words`` words; a larger
    benchmark takes more passes over the documents, one per block.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id bigint, item_id bigint, score double, start_word bigint, end_word bigint, n_seeds bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for table, widths in _blocks(source.select("text"), benchmark, block_words, item_id_col, item_text_col):
        def find(batches: Iterator[pa.RecordBatch], table=table, widths=widths) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _found(table.value, widths, batch.column(1), threshold)
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())),
                     *(pa.array([r[i + 1] for r in rows], kind) for i, kind in enumerate(kinds))],
                    names=[field.split()[0] for field in schema.split(", ")])

        out = out.unionByName(source.mapInArrow(find, schema))
    return out.withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS,
               text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item in the sense of ``contaminated``."""
    at = docs.columns.index(text_col)
    out = docs
    for table, widths in _blocks(docs.select(F.col(text_col).alias("text")), benchmark, block_words, item_id_col,
                                 item_text_col):
        def clean(batches: Iterator[pa.RecordBatch], table=table, widths=widths) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in _found(table.value, widths, batch.column(at), threshold)]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(clean, docs.schema)
    return out


def _blocks(texts: DataFrame, benchmark: DataFrame, block_words: int, id_col: str, text_col: str):
    """The seed table of each block of test items, with the seed widths in use."""
    words = benchmark.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0] / 5
    blocks = max(1, int(-(-words // block_words)))
    parts = (_items(benchmark, id_col, text_col, block, blocks) for block in range(blocks))
    return [_block(texts, items) for items in parts if items]


def _block(texts: DataFrame, items: list[tuple[int, np.ndarray]]):
    """Count the block's seeds over all texts and send the rare ones to the workers."""
    hashes, item, place = _seeds(items)
    distinct = np.unique(hashes)
    widths = sorted({min(SEED, len(words)) for _, words in items})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(distinct) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            for _, words, bounds in textscan.hashed_rows(batch.column(0), plain=True):
                for width in widths:
                    total[:-1] += np.bincount(_hits(words, bounds, distinct, width)[2], minlength=len(distinct))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"seed": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    counted = texts.mapInArrow(count, "seed bigint, n bigint").groupBy("seed").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(distinct) + 1, np.int64)
    for row in counted.collect():   # a row per seed of the block at most
        frequency[row.seed] = row.n
    texts_read = int(frequency[-1])
    often = frequency[np.searchsorted(distinct, hashes)]
    rare = often <= 4 * _medians(item, often, len(items))[item] + texts_read * SHARE
    table = texts.sparkSession.sparkContext.broadcast((items, hashes[rare], item[rare], place[rare]))

    return table, widths


def _found(table, widths: list[int], column: pa.Array, threshold: float) -> list[tuple]:
    """(row, item id, score, start word, end word, seeds) of the items held by a column's texts."""
    items, hashes, item, place = table
    known, first = np.unique(hashes, return_index=True)
    last, out = np.append(first[1:], len(hashes)), []
    size = np.array([len(words) for _, words in items])
    for start, words, bounds in textscan.hashed_rows(column, plain=True):
        for width in widths:
            rows, places, numbers = _hits(words, bounds, known, width)
            times = (last - first)[numbers]
            seed = np.repeat(first[numbers] - np.cumsum(times) + times, times) + np.arange(times.sum())
            row, where = np.repeat(rows, times), np.repeat(places, times)
            same = np.minimum(size[item[seed]], SEED) == width
            row, where, seed = row[same], where[same], seed[same]
            order = np.lexsort((where, item[seed], row))
            row, where, seed = row[order], where[order], seed[order]
            edge = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(item[seed], prepend=-1) != 0))
            for a, b in zip(edge, [*edge[1:], len(row)], strict=False):
                number, text = int(item[seed[a]]), words[bounds[row[a]]:bounds[row[a] + 1]]
                body, best = items[number][1], (0.0, 0, 0, 0)
                begins = where[a:b] - bounds[row[a]] - place[seed[a:b]]
                for left, right, seeds in _passages(begins, len(body), len(text), threshold):
                    if np.isin(body, text[left:right]).sum() < threshold * len(body):
                        continue   # the score is at most the number of the item's words in the passage
                    score, end = align(body, text[left:right])
                    if score > best[0]:
                        best = (score, left, left + end, seeds)
                if best[0] and best[0] >= threshold * len(body):
                    _, back = align(body[::-1], text[best[1]:best[2]][::-1])
                    out.append((start + int(row[a]), items[number][0], best[0] / len(body),
                                best[2] - back, best[2], best[3]))
    return out


def _medians(item: np.ndarray, often: np.ndarray, n: int) -> np.ndarray:
    """Per item the median of its positive counts, 0 without any."""
    item, often = item[often > 0], often[often > 0]
    order = np.lexsort((often, item))
    size = np.bincount(item, minlength=n)
    first = np.cumsum(size) - size
    middle = np.minimum(first + size // 2, max(len(order) - 1, 0))
    return np.where(size > 0, often[order][middle], 0) if len(order) else np.zeros(n, np.int64)
