"""Word and window hashes of whole Arrow text columns, as array operations.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. Those bytes
never occur inside a UTF-8 sequence, so words are found without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = 1 << 20
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, _BLOCK + 1024)
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, MULTIPLIER)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def row_slices(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows holding at most ``limit`` bytes, or one longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, min(end, rows)
        row = min(end, rows)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every byte span; spans are ascending and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        base = int(starts[i])
        part = data[base:int(ends[j - 1])]
        power, inverse = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[:len(part)], out=sums[1:])
        first, last = starts[i:j] - base, ends[i:j] - base
        value = (sums[last] - sums[first]) * inverse[first]
        out[i:j] = mix(value ^ ((last - first).astype(np.uint64) << np.uint64(48)))
        i = j
    return out


def words(data: np.ndarray, offsets: np.ndarray, first: int, end: int):
    """Words of rows first..end: (byte starts, byte ends, offsets of rows into the words)."""
    base, stop = int(offsets[first]), int(offsets[end])
    if stop == base:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(end - first + 1, np.int64)
    solid = ~_SPACE[data[base:stop]]
    breaks = np.zeros(stop - base + 1, bool)
    breaks[offsets[first:end + 1] - base] = True
    before = np.concatenate([[False], solid[:-1]])
    starts = np.flatnonzero(solid & (~before | breaks[:-1]))
    after = np.concatenate([solid[1:], [False]])
    ends = np.flatnonzero(solid & (~after | breaks[1:])) + 1
    bounds = np.searchsorted(starts, offsets[first:end + 1] - base)
    return starts + base, ends + base, bounds


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values (len - width + 1 of them)."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    total, done, part, size = None, 0, hashes, 1
    rest = width
    while rest:
        if rest & 1:
            n = len(hashes) - done - size + 1
            piece = part[done:done + n]
            if total is None:
                total = piece
            else:
                total = total[:n] * np.uint64(pow(int(MULTIPLIER), size, 1 << 64)) + piece
            done += size
        rest >>= 1
        if rest:
            part = part[:len(part) - size] * np.uint64(pow(int(MULTIPLIER), size, 1 << 64)) + part[size:]
            size *= 2
    return mix(total)


def window_rows(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the slice's words) of windows inside one row, and their rows."""
    counts = np.maximum(np.diff(bounds) - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    return bounds[:-1][rows] + inside, rows


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[:128] = [byte if chr(byte).isalnum() else 32 for byte in range(128)]
_PLAIN[65:91] += 32


# Beyond ASCII, all but letters, marks and numbers separates words.
_APART = r"[^\x00-\x7F\pL\pM\pN]+"


def _lowered(column: pa.Array) -> pa.Array:
    """Unicode lower case without punctuation beyond ASCII; letters whose upper case has other forms are made alike."""
    column = pc.utf8_lower(column)
    for letter, other in (("\u00df", "ss"), ("\u03c2", "\u03c3")):
        column = pc.replace_substring(column, letter, other)
    return pc.replace_substring_regex(column, _APART, " ")


def hashed_rows(column: pa.Array, plain: bool = False, limit: int = 1 << 21):
    """(first row, word hashes, offsets of rows into them) for runs of rows.

    plain: words are runs of letters, marks and digits in lower case; else words are as
    in the module's head, unchanged.
    """
    data, offsets = column_bytes(column)
    for first, end in row_slices(offsets, limit):
        part, local = data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        if plain:
            if len(part) and part.max() >= 128:
                part, local = column_bytes(_lowered(column.slice(first, end - first)))
                part, local = part[local[0]:local[-1]], local - local[0]
            part = _PLAIN[part]
        starts, ends, bounds = words(part, local, 0, end - first)
        yield first, hash_spans(part, starts, ends), bounds
