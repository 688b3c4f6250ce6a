"""Operator 2: exact duplicates through content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm import textscan
from wardlight.llm.stored import store

WINDOW = 16          # bytes that decide about a cut
CUT_BITS = 11        # a cut every 2,048 bytes on average
LONGEST = 1 << 14    # a longer chunk is cut every 16,384 bytes
_SPACES = bytes([9, 10, 11, 12, 13, 32])


def cuts(body: bytes) -> list[int]:
    """Ends of the chunks of a text; they depend on nearby bytes only."""
    data, n, found = np.frombuffer(body, np.uint8), len(body), []
    for begin in range(0, n, 1 << 20):
        part = data[max(0, begin - WINDOW + 1):begin + (1 << 20)]
        marks = textscan.rolling(textscan.mix(part.astype(np.uint64)), WINDOW) >> np.uint64(64 - CUT_BITS)
        found.append(np.flatnonzero(marks == 0) + max(0, begin - WINDOW + 1) + WINDOW)
    ends = [0, *np.concatenate(found).tolist(), n] if found else [0, n]
    out = []
    for left, right in zip(ends, ends[1:], strict=False):
        out += [*range(left + LONGEST, right, LONGEST), right] if right > left else []
    return out


def _chunks(text: str | None) -> tuple[bytes, list[bytes]]:
    body = (text or "").encode().translate(None, _SPACES)
    ends = cuts(body)
    return body, [body[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _digest(chunk: bytes, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def recipes(docs: DataFrame, digest_size: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_points (code points of the text), text_sha256 of the normalised text, and its recipe:
    the digests of its chunks in order, as one binary."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, sha, recipe = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                body, parts = _chunks(text)
                points.append(len(text))
                sha.append(hashlib.sha256(body).hexdigest())
                recipe.append(b"".join(_digest(part, digest_size) for part in parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(points, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(recipe, pa.binary())], names=["doc_id", "n_points", "text_sha256", "recipe"])

    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(scan, "doc_id bigint, n_points bigint, text_sha256 string, recipe binary")


def chunk_bodies(docs: DataFrame, digest_size: int = 16, text_col: str = "text") -> DataFrame:
    """Every chunk of every text: digest and body."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                parts = [part for value in batch.column(0).slice(begin, 1000) for part in _chunks(value.as_py())[1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(part, digest_size) for part in parts], pa.binary()),
                     pa.array(parts, pa.binary())], names=["digest", "body"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(scan, "digest binary, body binary")


def unverified(docs: DataFrame, digest_size: int = 16, text_col: str = "text") -> DataFrame:
    """Digests that stand for two or more different bodies.

    Each distinct body moves once; equal bodies meet in the map-side aggregate, so a
    chunk of a third of all documents is a row per task.
    """
    bodies = chunk_bodies(docs, digest_size, text_col).groupBy("digest", "body").agg(F.lit(1).alias("one"))
    return bodies.groupBy("digest").agg(F.count("*").alias("bodies")).filter("bodies > 1")


def exact_duplicates(docs: DataFrame, digest_size: int = 16, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after deleting space and \\t \\n \\v \\f \\r; a null text
    counts as empty, and empty texts are equal. Of equal texts the one with the most
    code points stays, then the smallest id, a null id last. Rows that repeat an id all
    count in group_size, and all carry kept if theirs is the id that stays. Extra
    columns are not read; an empty table gives an empty result.

    Every chunk digest is first verified to stand for one body. Should two bodies share
    one, longer digests are taken and verified in turn.
    """
    spark = docs.sparkSession
    while not store(spark, unverified(docs, digest_size, text_col), "chunk-collisions").isEmpty():
        if digest_size >= 64:
            raise ValueError("two different chunks have one 64-byte digest")
        digest_size = min(64, digest_size * 2)
    rows = store(spark, recipes(docs, digest_size, id_col, text_col), "chunk-recipes")
    best = F.max(F.struct("n_points", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("low")))
    groups = rows.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = groups.select("recipe", (-F.col("best.low")).alias("keep_id"), "group_size")
    return rows.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
