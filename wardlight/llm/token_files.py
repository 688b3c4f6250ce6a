"""Operator 5: flat token files with 64-bit offsets, written in ascending document order.

Layout of one part: ``<name>.bin`` holds the ids of its documents one after another,
little-endian, unsigned 16 bits where the vocabulary allows it, else 32. ``<name>.idx``
holds n document ids (int64), n null flags (uint8) and n + 1 offsets (uint64, in ids).
Parts follow each other by number; the base of a part is the sum of the parts before it.
"""

from __future__ import annotations

import gc
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm.stored import store

MEMO = 400_000   # distinct words that a Python worker remembers; then it starts anew
ROWS = 500
_WORD = re.compile("[^ \t\n\v\f\r]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"   # str.split parts at these, the tokenizer has tokens for them
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_ODD = frozenset("\u03a3\u0130'<")   # lower case of these depends on what is around, or they start a contraction
_LETTERS = "".join(chr(i) for i in range(0x180) if chr(i).islower() and chr(i) not in "\u00aa\u00ba")
_LOWER = re.compile(f"[{_LETTERS}]+")
# Byte-level tokenizers write these bytes as characters of their own, all others of a letter as Latin-1 does.
_BYTES = {byte: chr(290 + byte - 128) for byte in range(128, 161)} | {173: chr(323)}
_encoders: dict = {}


def _split(text: str) -> list[str]:
    """Words of a text; any white space parts tokens, so str.split serves where it has no other marks to part at."""
    return _WORD.findall(text) if any(mark in text for mark in _SEPARATORS) else text.split()


def _byte_level(word: str) -> str:
    return word.encode().decode("latin-1").translate(_BYTES)


@dataclass(frozen=True)
class TokenFiles:
    """Where the parts are: rows (part, name, documents, ids, base), one per file pair."""

    folder: str
    width: int
    parts: list


class _Encoder:
    """Ids per word: white space separates tokens, so a text's ids are those of its words."""

    def __init__(self, json: str, dtype: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.memo = Tokenizer.from_str(json), dtype, {}
        self.cores = {"": b""}
        special = [(i, token.content) for i, token in self.tokenizer.get_added_tokens_decoder().items()
                   if token.special and "<" in token.content]
        self.mark_id, self.mark = min(special, default=(-1, ""))
        # A word of small letters needs the model alone where nothing before it changes or parts such letters.
        self.direct = False
        if self.tokenizer.pre_tokenizer:
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(_LETTERS)
            self.direct = ([piece for piece, _ in pieces] == [_byte_level(_LETTERS)] and all(
                self._direct(word) == self.tokenizer.encode(word, add_special_tokens=False).ids
                for word in (_LETTERS, *_LETTERS)))

    def _direct(self, word: str) -> list[int]:
        return [token.id for token in self.tokenizer.model.tokenize(_byte_level(word))]

    def learn(self, words: set[str]) -> None:
        """Encode new words; one that is letters and then ASCII marks is joined from its two parts.

        The pattern that parts tokens always cuts between a letter and such a mark, and
        lower case comes first, so the parts' ids are those of the word.
        """
        parts = []
        for word in words:
            core = word.rstrip(_MARKS)
            if (core and core[-1].isalpha() and "<" not in word and "'" not in core
                    and (core.isascii() or not _ODD.intersection(core))):
                parts.append((word, core.lower(), word[len(core):]))
            else:
                parts.append((word, word, ""))
        if len(self.cores) >= 2 * MEMO:
            self.cores = {"": b""}
        cores, memo = self.cores, self.memo
        self._encode({core for _, core, _ in parts}.union({tail for _, _, tail in parts}).difference(cores))
        for word, core, tail in parts:
            memo[word] = cores[core] + cores[tail] if tail else cores[core]

    def _encode(self, words: set[str]) -> None:
        """Words of small letters go to the model; of the others many in one call: a special
        token, split off before all else, parts them."""
        if self.direct:
            letters = [word for word in words if _LOWER.fullmatch(word)]
            words = words.difference(letters)
            tokenize, pack = self.tokenizer.model.tokenize, np.dtype(self.dtype)
            for begin in range(0, len(letters), 2000):
                some = letters[begin:begin + 2000]
                ids, ends = [], []
                for word in some:
                    ids += [token.id for token in tokenize(word if word.isascii() else _byte_level(word))]
                    ends.append(pack.itemsize * len(ids))
                raw, start = np.array(ids, pack).tobytes(), 0
                for word, stop in zip(some, ends, strict=True):
                    self.cores[word] = raw[start:stop]
                    start = stop
        plain = [word for word in words if self.mark and "<" not in word]
        for begin in range(0, len(plain), 2000):
            some = plain[begin:begin + 2000]
            ids = np.array(self.tokenizer.encode(self.mark.join(some), add_special_tokens=False).ids, self.dtype)
            ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
            if len(ends) != len(some):
                raise ValueError("the parting token was not kept apart")
            raw, width, start = ids.tobytes(), ids.itemsize, 0
            for word, stop in zip(some, ends, strict=True):
                self.cores[word] = raw[width * start:width * stop]
                start = stop + 1
        for word in words.difference(plain):
            self.cores[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def batch(self, texts: list[str], end: bytes) -> list[bytes]:
        gc.disable()   # no cycles arise here, and walking the remembered words costs time
        try:
            words = [_split(text) for text in texts]
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.learn(set().union(*words).difference(self.memo))
            return [b"".join([*map(self.memo.__getitem__, row), end]) for row in words]
        finally:
            gc.enable()


def _encoder(json: str, dtype: str) -> _Encoder:
    """The encoder of this Python worker, with the words it remembers from earlier tasks.

    A task reaches it by this function's name: a dictionary that the task's own function
    named would be sent along, empty for every task.
    """
    key = hashlib.sha256(json.encode()).digest(), dtype
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = _Encoder(json, dtype)
    return _encoders[key]


def _open(folder: str):
    """The file system of a folder's address and the folder's path there."""
    return pa.fs.FileSystem.from_uri(folder) if urlparse(folder).scheme else (pa.fs.LocalFileSystem(), folder)


def _read(folder: str, name: str, dtype: str) -> np.ndarray:
    fs, base = _open(folder)
    if not fs.get_file_info(f"{base}/{name}").size:
        return np.zeros(0, dtype)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(f"{base}/{name}", dtype, "r")
    with fs.open_input_file(f"{base}/{name}") as file:
        return np.frombuffer(file.read_buffer(), dtype)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, parts: int | None = None,
                      id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encode every text, append ``end_id``, and write part files below ``folder``.

    Documents are range-partitioned and sorted by id (nulls first; rows that repeat an
    id by text), so the parts in order hold ascending ids. A null text counts as empty
    and holds the end id alone. Other columns are not read; an empty table gives no
    parts. A task writes under a fresh name and reports it, so a retry never touches a
    finished file; the driver gets one row per part, and prefix sums over these
    give each part's base.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        json = file.read()
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(json).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    dtype, sent = f"<u{width}", spark.sparkContext.broadcast(json)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(sent.value, dtype)
        end, part = np.array([end_id], dtype).tobytes(), TaskContext.get().partitionId()
        name, out = f"part-{part:06d}-{uuid.uuid4().hex}", None
        fs, base = _open(folder)
        ids, lengths = [], []
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS):
                rows = batch.slice(begin, ROWS)
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}.bin")
                data = encoder.batch([text or "" for text in rows.column(1).to_pylist()], end)
                out.write(b"".join(data))
                lengths += [len(x) // width for x in data]
                ids.append(rows.column(0))
        if out is None:
            return
        out.close()
        every = pa.chunked_array(ids).combine_chunks()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        with fs.open_output_stream(f"{base}/{name}.idx") as index:
            index.write(every.fill_null(0).to_numpy().astype("<i8").tobytes())
            index.write(every.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
            index.write(offsets.tobytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "name": [name],
                                          "documents": pa.array([len(lengths)], pa.int64()),
                                          "ids": pa.array([int(offsets[-1])], pa.int64())})

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    done = store(spark, ordered.mapInArrow(write, "part bigint, name string, documents bigint, ids bigint"),
                       "token-parts")
    listed, base = [], 0
    for row in sorted(done.collect(), key=lambda row: row.part):
        listed.append((row.part, row.name, row.documents, row.ids, base))
        base += row.ids
    return TokenFiles(folder, width, listed)


def _index(folder: str, name: str, documents: int) -> tuple[pa.Array, np.ndarray]:
    raw = np.asarray(_read(folder, f"{name}.idx", "u1"))
    ids = raw[:8 * documents].view("<i8")
    null = raw[8 * documents:9 * documents].astype(bool)
    offsets = np.frombuffer(raw[9 * documents:].tobytes(), "<u8").astype(np.int64)
    return pa.array(ids, pa.int64(), mask=null), offsets


def read_token_files(spark: SparkSession, files: TokenFiles, ids: bool = True) -> DataFrame:
    """The documents in the files: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids.

    start counts the ids of all documents before it; ids_crc32 is taken of the ids as
    32-bit integers whatever the width in the file.
    """
    folder, dtype = files.folder, f"<u{files.width}"
    fields = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                every, offsets = _index(folder, row["name"], row["documents"])
                tokens = _read(folder, row["name"] + ".bin", dtype)
                for begin in range(0, row["documents"], ROWS):
                    end = min(begin + ROWS, row["documents"])
                    spans = [np.asarray(tokens[offsets[i]:offsets[i + 1]]) for i in range(begin, end)]
                    columns = [every.slice(begin, end - begin), pa.array(row["base"] + offsets[begin:end], pa.int64()),
                               pa.array(np.diff(offsets[begin:end + 1]), pa.int64()),
                               pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in spans], pa.int64())]
                    if ids:
                        columns.append(pa.array([x.astype(np.int32) for x in spans], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in fields.split(", ")])

    schema = "part bigint, name string, documents bigint, ids bigint, base bigint"
    parts = spark.createDataFrame(files.parts, schema)
    return parts.repartition(max(1, len(files.parts)), "part").mapInArrow(read, fields)


def lookup(files: TokenFiles, part: int, position: int) -> np.ndarray:
    """Ids of one document of one part, straight from the mapped file."""
    name, documents = next((row[1], row[2]) for row in files.parts if row[0] == part)
    _, offsets = _index(files.folder, name, documents)
    return np.asarray(_read(files.folder, name + ".bin", f"<u{files.width}")[offsets[position]:offsets[position + 1]])
