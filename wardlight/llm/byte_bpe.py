"""Operator 3: byte-level BPE by dynamic programming over prefixes.

Every byte prefix of a piece has one valid last token: the one whose predecessor,
the last token of the shorter prefix, may stand before it. Keeping that token per
prefix makes appends exact and lets an edit re-encode only what follows it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 700_000   # distinct pieces that a Python worker remembers; then it starts anew
ROWS = 500        # texts split at once
_codecs: dict = {}


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64 rank``."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


class Prefixes:
    """The tokens of a growing piece: ``last[i]`` ends the encoding of the first i bytes."""

    def __init__(self, codec: Codec, data: bytes = b""):
        self.codec, self.data, self.last = codec, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.codec.extend(self.data, self.last)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace bytes start..end; prefixes before ``start`` stay as they are."""
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start + 1:]
        self.codec.extend(self.data, self.last)

    def ids(self) -> list[int]:
        whole = self.codec.ranks.get(self.data)
        return [whole] if whole is not None else self.codec.trace(self.last)


class Codec:
    """Encoder and decoder for one table of ranks and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joins: dict[tuple[int, int], int] = {}
        self.pairs: dict[int, bool] = {}
        self._learn_merges()
        # Every end of a token, with the token that it is or -1: beyond these a suffix can't grow to a token.
        self.suffixes = {token[i:]: -1 for token in ranks for i in range(len(token))}
        self.suffixes.update((token, rank) for token, rank in ranks.items() if rank in self.halves)

    def _learn_merges(self) -> None:
        """Which two tokens each token is merged from, if merges reach it at all."""
        for token, rank in sorted(self.ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                self.halves[rank] = (rank, rank)
                continue
            parts = self.merged(token, below=rank)
            if len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
                self.joins[parts[0], parts[1]] = rank

    def merged(self, data: bytes, below: int) -> list[int]:
        """Plain lowest-rank-first merging with ranks under ``below``; for single tokens only."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if best >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives just these two tokens.

        Undo merges from the latest back: at each step the border must not have been
        merged by a rank that comes before the token undone last.
        """
        bound = 1 << 62
        while True:
            joined = self.joins.get((left, right))
            if joined is not None and joined < bound:
                return False
            later_left = left > right
            if later_left:
                bound, inner = left, self.halves[left][1]
                if inner != left:
                    left = inner
                    continue
            bound, inner = right + 1, self.halves[right][0]
            if inner != right:
                right = inner
                continue
            if later_left:
                return True
            bound, inner = left, self.halves[left][1]
            if inner == left:
                return True
            left = inner

    def extend(self, data: bytes, last: list[int]) -> None:
        """Add the last token of every prefix of ``data`` that ``last`` lacks."""
        get, pairs = self.suffixes.get, self.pairs
        if len(pairs) > 4 * MEMO:
            pairs.clear()
        for end in range(len(last), len(data) + 1):
            found = -1
            for start in range(end - 1, -1, -1):
                token = get(data[start:end])
                if token is None:
                    break
                if token < 0:
                    continue
                if start:
                    pair = (last[start] << 32) | token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self.may_follow(last[start], token)
                    if not fits:
                        continue
                found = token
                break
            if found < 0:
                raise ValueError("the ranks lack a single byte")
            last.append(found)

    def trace(self, last: list[int]) -> list[int]:
        ids, end = [], len(last) - 1
        while end:
            ids.append(last[end])
            end -= len(self.bytes[last[end]])
        ids.reverse()
        return ids

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode new pieces in byte order, each from the prefix it shares with the one before."""
        before, last = b"", [-1]
        for data, text in sorted((text.encode(), text) for text in pieces):
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del last[shared + 1:]
            self.extend(data, last)
            whole = self.ranks.get(data)   # a piece that is a token itself is never split
            self.memo[text] = (whole,) if whole is not None else tuple(self.trace(last))
            before = data

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        parts = [self.split.findall(text) for text in texts]
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.learn(set().union(*parts).difference(self.memo))
        for pieces in parts:
            yield list(chain.from_iterable(map(self.memo.__getitem__, pieces)))

    def encode(self, text: str) -> list[int]:
        return next(self.encode_batch([text]))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def codec_of(lines: bytes, pattern: str) -> Codec:
    """The worker's codec for these ranks; building it takes about a second."""
    key = (hashlib.sha256(lines).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(lines), pattern)
    return _codecs[key]


_COLUMNS = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("binary", pa.binary()),
            "n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()),
            "decoded_sha256": ("string", pa.string())}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, outputs: tuple[str, ...] = ("ids",),
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and the chosen outputs.

    outputs: ``ids``, ``decoded`` (bytes decoded from the ids), ``n_tokens``, and the
    digests ``ids_sha256`` (decimal ids joined by commas) and ``decoded_sha256``.
    A null text counts as empty: no ids, empty bytes. Rows that repeat, and null ids,
    are encoded like any other; other columns are not read. An empty table gives an
    empty result. No shuffle; a worker remembers the ids of frequent pieces. The
    rank file is read by the driver and sent to workers; its size is that of a vocabulary.
    """
    with open(ranks_path, "rb") as file:
        lines = docs.sparkSession.sparkContext.broadcast(file.read())
    outputs = tuple(outputs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(lines.value, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                columns: dict[str, list] = {name: [] for name in outputs}
                for ids in codec.encode_batch([text or "" for text in part.column(1).to_pylist()]):
                    decoded = codec.decode(ids) if "decoded" in columns or "decoded_sha256" in columns else b""
                    for name, out in columns.items():
                        if name == "ids":
                            out.append(ids)
                        elif name == "decoded":
                            out.append(decoded)
                        elif name == "n_tokens":
                            out.append(len(ids))
                        elif name == "ids_sha256":
                            out.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                        else:
                            out.append(hashlib.sha256(decoded).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(columns[name], _COLUMNS[name][1]) for name in outputs)],
                    names=["id", *outputs])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(["id bigint", *(f"{name} {_COLUMNS[name][0]}" for name in outputs)])
    return source.mapInArrow(encode, schema).withColumnRenamed("id", id_col)


def decode_documents(tokens: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``tokens``: its id and ``decoded`` bytes; null ids decode to none.

    An unknown token id raises an error.
    """
    with open(ranks_path, "rb") as file:
        lines = tokens.sparkSession.sparkContext.broadcast(file.read())

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {rank: token for token, rank in read_ranks(lines.value).items()}
        for batch in batches:
            data = [b"".join(map(table.__getitem__, value.as_py() or ())) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["id", "decoded"])

    source = tokens.select(F.col(id_col).cast("bigint").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return source.mapInArrow(decode, "id bigint, decoded binary").withColumnRenamed("id", id_col)
