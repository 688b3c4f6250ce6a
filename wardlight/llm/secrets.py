"""Operator 9: secrets, with weak parts reported only beside their complements."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = 300          # characters between complementary parts at most
ENTROPY = 0.8        # of the most that a weak secret's alphabet and length allow, at least
KINDS = ("assign", "access", "hex", "id_part", "key_part")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = re.compile(rf"""(?:{_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_NAME = re.compile(r"(?i:passw(?:or)?d|secret|token|api_?key)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ID_NAMES = "|".join(map(_either_case, ("client_id", "access_key", "access_key_id", "account", "username", "user")))
_WEAK_ID = re.compile(rf"""(?<![A-Za-z0-9_])(?:{_ID_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{{3,}})"""
                      r"|(?<![A-Z0-9])A[A-Z]IA[A-Z0-9]{8,}")
_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")
_WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_-])")
_CONTEXT = re.compile(rf"""(?<![A-Za-z0-9_])(?:{'|'.join(map(_either_case, ("passphrase", "pass", "pwd", "pw", "key", "pin", "credential")))})"""
                      r"""["']?\x20*[:=]?\x20*["']?(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])([A-Za-z0-9+/_.=!@#%^*-]{6,})""")
_ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._-]+|"
                       rf"""(?<![A-Za-z0-9_])(?:{'|'.join(map(_either_case, ("host", "endpoint", "server")))})"""
                       r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]+""")


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def random_looking(text: str) -> bool:
    """Whether two classes of digits, lower and upper case occur, and characters vary as in a key of its alphabet."""
    classes = (any(c.isdigit() for c in text), any(c.islower() for c in text), any(c.isupper() for c in text))
    if sum(classes) < 2:
        return False
    alphabet = 16 if set(text) <= _HEX_DIGITS else 10 * classes[0] + 26 * classes[1] + 26 * classes[2]
    return entropy(text) >= ENTROPY * math.log2(min(alphabet, len(text)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three plain kinds, in order."""
    found = []
    if _ASSIGN_NAME.search(text):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _meets(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray, reach: int) -> np.ndarray:
    """Which spans have an interval within reach; intervals are ascending and apart."""
    if not len(starts):
        return np.zeros(len(spans), bool)
    first = np.searchsorted(ends, spans[:, 0] - reach)
    return (first < len(starts)) & (starts[np.minimum(first, len(starts) - 1)] <= spans[:, 1] + reach)


def _table(spans) -> np.ndarray:
    return np.array(sorted(spans), np.int64).reshape(-1, 2)


def _apart(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and running ends; for the nearest-interval test only order matters."""
    return spans[:, 0], np.maximum.accumulate(spans[:, 1]) if len(spans) else spans[:, 1]


def linked_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Weak identifiers near a secret and weak secrets near an identifier or an endpoint.

    Weak identifiers are names such as user or client_id with a value, and access identifiers of
    unusual form. Weak secrets are runs of 20 or more key characters that look random, and values
    with letters and digits right after a word such as pass or key. Interval join by position in one
    document: a part's scope reaches SCOPE characters to both sides. A weak part that overlaps a plain
    span, or has no complement in its scope, is not reported, nor is a secret that overlaps a reported identifier.
    """
    taken = _apart(_table((a, b) for a, _, b in base))
    ids = _table(m.span() for m in _WEAK_ID.finditer(text))
    runs = _table(m.span() for m in _WEAK_KEY.finditer(text) if random_looking(m[0]))
    named = _table(m.span(1) for m in _CONTEXT.finditer(text))
    named = named[~_meets(named, *_apart(runs), -1)]
    keys = _table(map(tuple, np.concatenate([runs, named])))
    if not len(ids) and not len(keys):
        return []
    ids = ids[~_meets(ids, *taken, -1)] if len(ids) else ids
    keys = keys[~_meets(keys, *taken, -1)] if len(keys) else keys
    strong_ids = [(a, b) for a, kind, b in base if kind == 1]
    strong_keys = [(a, b) for a, kind, b in base if kind != 1]
    ends = _table(m.span() for m in _ENDPOINT.finditer(text)) if len(keys) else _table(())
    out = []
    if len(ids):
        # An identifier's own value may look like a secret; only another one is its complement.
        apart = _table([*map(tuple, keys[~_meets(keys, *_apart(ids), -1)]), *strong_keys])
        ids = ids[_meets(ids, *_apart(apart), SCOPE)]
        out += [(int(a), 3, int(b)) for a, b in ids]
        keys = keys[~_meets(keys, *_apart(ids), -1)]
    if len(keys):
        all_ids = _table([*map(tuple, ids), *strong_ids])
        near = _meets(keys, *_apart(all_ids), SCOPE) | _meets(keys, *_apart(ends), SCOPE)
        out += [(int(a), 4, int(b)) for a, b in keys[near]]
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and ``found``, an array of (kind, start, end, base).

    Positions are code points of the whole text, end exclusive, ordered by start and
    then kind. Kinds: assign, access and hex as plain patterns (base), id_part and
    key_part as weak parts that have a complement within SCOPE characters. A null or
    empty text has none; repeated rows and null ids are treated like any other; extra
    columns are not read; an empty table gives an empty result. No shuffle: parts
    are joined inside their document.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": k < 3}
                             for a, k, b in sorted(base + linked_spans(text, base))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(kind))], names=["id", "found"])

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id bigint, found array<struct<kind: string, start: bigint, end: bigint, base: boolean>>"
    return source.mapInArrow(scan, schema).withColumnRenamed("id", id_col)
