"""Operator 6: toxicity by the nearest labelled examples under TF-IDF cosine, with block maxima.

The space has every term of the labelled examples; idf counts all documents and is raised by
how unevenly the term is spread over the two labels. The index is inverted: rare terms
are lists of postings, all of which are added up; a frequent term is a row over all examples, with its
highest weight in each block of examples. Rare scores and block maxima bound every block, and only
blocks whose bound reaches the k-th best cosine are scored in full, so the k nearest are exact. Texts are searched
some at a time, so that bounds and scores are products of matrices; examples lie in the order of their
commonest terms, which keeps a language together.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm import textscan
from wardlight.llm.stored import discard, store

EXAMPLES = 20_000    # labelled rows to learn from, at most
TERMS = None         # terms kept, those most unevenly spread over the two labels; None keeps all
FLOOR = 0.1          # weight of a term that is spread evenly
NEIGHBOURS = 25
CALIBRATION = 5      # one in so many examples is set apart to calibrate votes
BLOCK = 32           # examples in a block of the index
FREQUENT = 16        # a term of more than one in so many examples has block maxima
TOGETHER = 256       # texts searched at once
LEAD = 3             # commonest terms that order the examples
SLACK = 1e-5         # of single precision sums


def one_thread() -> None:
    """Matrix products stay on the task's own core: more threads than cores wait for each other at full load.

    Tells the OpenBLAS library that numpy brings along; with another library nothing changes.
    """
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


class Lookup:
    """Positions of hashes among sorted known ones: a table by low bits, and a sorted list of those whose place is taken."""

    def __init__(self, known: np.ndarray):
        self.known, bits = known, max(4, (4 * len(known)).bit_length() - 1)
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.full(1 << bits, -1, np.int32)
        place, own = (known & self.mask).astype(np.int64), np.arange(len(known), dtype=np.int32)
        self.table[place] = own
        self.rest = np.flatnonzero(self.table[place] != own)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the known ones among the hashes, and their positions."""
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self.table[(hashes & self.mask).view(np.int64)].astype(np.int64)
        other = np.flatnonzero((at >= 0) & (self.known[at] != hashes))
        at[other] = -1
        if len(other) and len(self.rest):
            rest = self.known[self.rest]
            near = np.minimum(np.searchsorted(rest, hashes[other]), len(rest) - 1)
            same = rest[near] == hashes[other]
            at[other[same]] = self.rest[near[same]]
        hit = np.flatnonzero(at >= 0)
        return at[hit], hit


@dataclass
class Index:
    """Labelled examples by term."""

    terms: np.ndarray        # sorted term hashes
    idf: np.ndarray          # raised by the term's association with the label
    labels: np.ndarray
    ids: np.ndarray
    first: np.ndarray        # of each term's postings
    examples: np.ndarray
    weights: np.ndarray
    knots: tuple             # votes and calibrated scores
    empty: float             # score of a text without any of the terms
    dense: tuple | None = None    # frequent terms as matrices, and a lookup of terms; made where they are used
    lookup: Lookup | None = None
    pairs: np.ndarray | None = None

    def release(self) -> None:
        """Let go what a worker made for its task; idle workers keep their memory."""
        self.dense = self.lookup = self.pairs = None

    def _matrices(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Column of each term (-1: rare), weights by block, example and column, and their maxima by column and block."""
        if self.dense is None:
            lengths, blocks = np.diff(self.first), -(-len(self.labels) // BLOCK)
            frequent = np.flatnonzero(lengths * FREQUENT > len(self.labels))
            column = np.full(len(lengths), -1, np.int32)
            column[frequent] = np.arange(len(frequent))
            rows = np.zeros((blocks * BLOCK, len(frequent)), np.float32)
            for number, term in enumerate(frequent.tolist()):
                at = slice(self.first[term], self.first[term + 1])
                rows[self.examples[at], number] = self.weights[at]
            rows = rows.reshape(blocks, BLOCK, len(frequent))
            self.dense = column, rows, np.ascontiguousarray(rows.max(axis=1).T)
            self.pairs = np.column_stack([self.examples, self.weights.view(np.int32)])   # one piece of memory a posting
        return self.dense

    def search(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (terms, weights): the k examples of highest cosine above 0, ties by position, and the cosines."""
        column, rows, highest = self._matrices()
        blocks, n, width = len(rows), len(rows) * BLOCK, rows.shape[2]
        weights = np.zeros((len(texts), width), np.float32)
        for i, (terms, shares) in enumerate(texts):
            at = column[terms]
            weights[i, at[at >= 0]] = shares[at >= 0]
        bound = weights @ highest
        order = np.argsort(bound.argmax(axis=1), kind="stable")   # texts of one language together
        found: list = [None] * len(texts)
        for start in range(0, len(texts), TOGETHER):
            some = order[start:start + TOGETHER]
            scores = np.stack([self._rare(*texts[i], column, n) for i in some]).reshape(len(some), blocks, BLOCK)
            bounds = bound[some] + scores.max(axis=2)
            least, few = np.zeros(len(some), np.float32), min(blocks, 2 * k // BLOCK + 4)
            for i in range(len(some)):   # a lower limit of the k-th best cosine, from the most promising blocks
                first = np.argpartition(bounds[i], blocks - few)[blocks - few:]
                best = (scores[i, first] + rows[first] @ weights[some[i]]).ravel()
                least[i] = np.partition(best, -k)[-k] if len(best) >= k else 0.0
            open_ = np.flatnonzero((bounds * (1 + SLACK) + SLACK >= least[:, None]).any(axis=0))
            part = rows if 2 * len(open_) > blocks else rows[open_]
            open_ = np.arange(blocks) if part is rows else open_
            cosine = scores[:, open_].reshape(len(some), -1) + weights[some] @ part.reshape(len(part) * BLOCK, width).T
            places = (open_[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            for i, text in enumerate(some):
                hit = np.flatnonzero((cosine[i] >= least[i] * (1 - SLACK) - SLACK) & (cosine[i] > 0))
                hit = hit[np.lexsort((places[hit], -cosine[i, hit]))[:k]]
                found[text] = places[hit], cosine[i, hit]
        return found

    def _rare(self, terms: np.ndarray, shares: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        """What rare terms add to the cosine of every example."""
        rare = column[terms] < 0
        begins, ends = self.first[terms[rare]], self.first[terms[rare] + 1]
        if not len(begins):
            return np.zeros(n, np.float32)
        pairs = np.concatenate([self.pairs[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)])
        added = np.repeat(shares[rare].astype(np.float32), ends - begins) * pairs[:, 1].view(np.float32)
        return np.bincount(pairs[:, 0], added, n).astype(np.float32)

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        weight = 1.0 / (1.05 - np.minimum(cosine, 1.0))
        return float((weight * self.labels[found]).sum() / weight.sum()) if len(found) else float(self.empty)

    def score(self, vote: float) -> float:
        return float(np.interp(vote, *self.knots))


def _counts(hashes: np.ndarray, bounds: np.ndarray, lookup: Lookup):
    """Rows, term numbers and counts of the known terms in a run of rows."""
    terms, hit = lookup.find(hashes)
    rows = np.searchsorted(bounds, hit, "right") - 1
    n = max(1, len(lookup.known))
    keys, counts = np.unique(rows * n + terms, return_counts=True)
    return keys // n, keys % n, counts


def _vector(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weights = (1.0 + np.log(counts)) * idf[terms]
    return weights / np.sqrt((weights * weights).sum())


def _labelled(docs: DataFrame, labels: DataFrame, examples: int) -> DataFrame:
    """At most ``examples`` labelled texts outside the held-out fifth, chosen by a hash of the id.

    An id that several rows have gives one example, the text of smallest hash.
    Their ids are the only thing broadcast: 16 bytes each, so 320 KB by default.
    """
    chosen = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 5 != 0")
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    first = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"))
    return first.select("doc_id", "row.text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, terms: int | None = TERMS) -> Index:
    """The index of the labelled examples over all their terms, with idf over all documents.

    Bounded by the text of ``examples`` labelled rows, which is all that comes to the driver.
    """
    spark = docs.sparkSession

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, bounds in textscan.hashed_rows(batch.column(1), plain=True):
                n = len(bounds) - 1
                rows = np.repeat(np.arange(n), np.diff(bounds))
                order = np.lexsort((hashes, rows))
                rows, hashes = rows[order], hashes[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
                at = np.flatnonzero(new)
                counts = np.diff(np.append(at, len(rows))).astype(np.int32)
                offsets = pa.array(np.searchsorted(rows[at], np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(2).slice(first, n),
                     pa.ListArray.from_arrays(offsets, pa.array(hashes[at].view(np.int64))),
                     pa.ListArray.from_arrays(offsets, pa.array(counts))],
                    names=["doc_id", "toxic", "terms", "counts"])

    bags = store(spark, _labelled(docs, labels, examples).select("doc_id", "text", "toxic").mapInArrow(
        bag, "doc_id bigint, toxic int, terms array<bigint>, counts array<int>"), "toxicity-examples")
    frequency = _frequencies(docs, bags)
    # Votes of a fifth of the examples, by an index of the others, against their labels: a rising step function.
    apart = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(CALIBRATION)) == 0
    index = _index(bags.filter(~apart), frequency, terms)
    if len(index.labels):
        sent = spark.sparkContext.broadcast(index)

        def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one_thread()
            index = sent.value
            for batch in batches:
                texts = []
                for hashes, counts in zip(batch.column(1), batch.column(2), strict=True):
                    at, hit = _known(index.terms, hashes.values.to_numpy().view(np.uint64))
                    texts.append((at, _vector(at, counts.values.to_numpy()[hit], index.idf)))
                found = [index.vote(*near) if len(near[0]) else None for near in index.search(texts, NEIGHBOURS)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["toxic", "vote"])

        found = bags.filter(apart).select("toxic", "terms", "counts").mapInArrow(votes, "toxic int, vote double").toArrow()
        found = found.filter(pc.is_valid(found["vote"]))
        sent.destroy()
        if len(found):
            knots = rising(found["vote"].to_numpy(), found["toxic"].to_numpy().astype(float))
            index = None
            index = _index(bags, frequency, terms)
            index.knots = knots
            discard(bags)
            return index
    index = _index(bags, frequency, terms)
    discard(bags)
    return index


def _known(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the known ones among sorted hashes, and their positions."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = np.flatnonzero(known[at] == hashes)
    return at[hit], hit


def _frequencies(docs: DataFrame, bags: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted terms of the examples, the documents that hold each, and the number of documents."""
    spark = docs.sparkSession
    known = np.sort(bags.select(F.explode("terms").alias("t")).distinct().toArrow()["t"].to_numpy().view(np.uint64))
    sent = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value)
        total = np.zeros(len(sent.value) + 1, np.int64)
        for batch in batches:
            total[-1] += batch.num_rows
            if len(sent.value):
                for _, hashes, bounds in textscan.hashed_rows(batch.column(0), plain=True):
                    np.add.at(total, _counts(hashes, bounds, lookup)[1], 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})

    summed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term bigint, n bigint")
    summed = summed.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    sent.destroy()
    frequency = np.zeros(len(known) + 1, np.int64)
    frequency[summed["term"].to_numpy()] = summed["n"].to_numpy()
    return known, frequency[:-1], int(frequency[-1])


def _index(bags: DataFrame, frequency: tuple[np.ndarray, np.ndarray, int], terms: int | None) -> Index:
    """The inverted index of some examples. Spark weighs and sorts the postings; the driver gets them once, as 12 bytes each."""
    spark = bags.sparkSession
    spread = bags.select("toxic", F.explode("terms").alias("t")).groupBy("t").agg(
        F.count("*").cast("int").alias("n"), F.sum("toxic").cast("int").alias("bad")).toArrow()
    own = spread["t"].to_numpy().view(np.uint64)
    order = np.argsort(own)
    own, held, bad = own[order], spread["n"].to_numpy()[order], spread["bad"].to_numpy()[order]
    heads = _heads(bags, own, held)
    used = heads["used"].to_numpy(zero_copy_only=False)
    ids, toxic = heads["doc_id"].to_numpy(), heads["toxic"].to_numpy().astype(float)
    rate = toxic.mean() if len(toxic) else 0.0
    expected = held * rate
    uneven = (np.abs(bad - expected) - 0.5) / np.sqrt(expected + 0.5)
    if terms is not None and terms < len(own):
        chosen = np.sort(np.lexsort((own, -uneven))[:terms])
        own, uneven = own[chosen], uneven[chosen]
    seen = frequency[1][np.searchsorted(frequency[0], own)] if len(own) else np.zeros(0)
    idf = (np.log((1 + frequency[2]) / (1 + seen)) + 1.0) * (FLOOR + np.maximum(uneven, 0.0))
    empty = toxic[~used]
    index = Index(own, idf, toxic[used], ids[used], np.zeros(len(own) + 1, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32),
                  (np.array([0.0, 1.0]), np.array([0.0, 1.0])), float((empty.sum() + rate) / (len(empty) + 1)))
    if not len(own):
        return index
    by_id = np.argsort(index.ids, kind="stable")
    sent = spark.sparkContext.broadcast((own, idf, index.ids[by_id], by_id.astype(np.int32)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf, ids, place = sent.value
        for batch in batches:
            for doc, hashes, counts in zip(*batch.columns, strict=True):
                at, hit = _known(known, hashes.values.to_numpy().view(np.uint64))
                weights = _vector(at, counts.values.to_numpy()[hit], idf).astype(np.float32) if len(at) else np.zeros(0, np.float32)
                example = np.full(len(at), place[np.searchsorted(ids, doc.as_py())], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(example), pa.array(weights)],
                                                 names=["term", "example", "weight"])

    postings = bags.filter(F.size("terms") > 0).select("doc_id", "terms", "counts").mapInArrow(weigh, "term int, example int, weight float")
    table = postings.orderBy("term", "example").toArrow()
    sent.destroy()
    index.first = np.searchsorted(table["term"].to_numpy(), np.arange(len(own) + 1)).astype(np.int32)
    index.examples, index.weights = table["example"].to_numpy(), table["weight"].to_numpy()
    return index


def _heads(bags: DataFrame, known: np.ndarray, held: np.ndarray) -> pa.Table:
    """doc_id, toxic and whether it has terms, of each example, in the order of its commonest terms."""
    sent = bags.sparkSession.sparkContext.broadcast((known, held))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = sent.value
        for batch in batches:
            leads = []
            for hashes in batch.column(2):
                at = _known(known, hashes.values.to_numpy().view(np.uint64))[0]
                top = at[np.lexsort((at, -held[at]))[:LEAD]]
                leads.append([*top.tolist(), *[-1] * (LEAD - len(top))])
            lead_columns = [pa.array([row[i] for row in leads], pa.int32()) for i in range(LEAD)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pc.greater(pc.list_value_length(batch.column(2)), 0),
                                              *lead_columns], names=["doc_id", "toxic", "used", *(f"lead{i}" for i in range(LEAD))])

    leads = ", ".join(f"lead{i} int" for i in range(LEAD))
    heads = bags.select("doc_id", F.col("toxic").cast("int").alias("toxic"), "terms").mapInArrow(
        lead, f"doc_id bigint, toxic int, used boolean, {leads}").toArrow()
    sent.destroy()
    return heads.sort_by([*((f"lead{i}", "ascending") for i in range(LEAD)), ("doc_id", "ascending")])


def rising(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means of the labels by vote, in groups of equal votes."""
    values, inverse = np.unique(votes, return_inverse=True)
    total, weight = np.bincount(inverse, labels), np.bincount(inverse).astype(float)
    pools: list[list[float]] = []
    for value, s, w in zip(values, total, weight, strict=True):
        pools.append([s, w, value, value])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, w, _, top = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += w
            pools[-1][3] = top
    x = np.array([v for pool in pools for v in (pool[2], pool[3])])
    y = np.repeat([(s + 0.05) / (w + 0.1) for s, w, _, _ in pools], 2)
    return x + np.arange(len(x)) * 1e-12, np.maximum.accumulate(y)


def score_documents(docs: DataFrame, index: Index, k: int = NEIGHBOURS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), vote, evidence (ids of up to 3 neighbours).

    Texts are read whole. A null or empty text, and one without any term of the examples, has no
    neighbour; its score is the labelled rate of such texts. Terms of no example are left out of the cosine. Repeated rows score alike;
    extra columns are not read; an empty table gives an empty result. The index is
    bounded by the text of EXAMPLES rows and goes to every worker.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        known: dict = {}
        for batch in batches:
            out = _scored(sent.value, batch.column(1), k, known)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in out], pa.float64()),
                 pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))],
                names=["id", "score", "vote", "evidence"])
        sent.value.release()

    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(score, "id bigint, score double, vote double, evidence array<bigint>").withColumnRenamed(
        "id", id_col)


def keep_below(docs: DataFrame, index: Index, cutoff: float = 0.5, k: int = NEIGHBOURS,
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``cutoff``."""
    sent, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        known: dict = {}
        for batch in batches:
            yield batch.filter(pa.array([x[0] < cutoff for x in _scored(sent.value, batch.column(at), k, known)],
                                        pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def _scored(index: Index, column: pa.Array, k: int, known: dict) -> list[tuple[float, float, list[int]]]:
    """(score, vote, evidence) of every text; equal term counts are searched once."""
    out = [(index.empty, index.empty, [])] * len(column)
    if not len(index.terms):
        return out
    for first, hashes, bounds in textscan.hashed_rows(column, plain=True):
        index.lookup = index.lookup or Lookup(index.terms)
        rows, terms, counts = _counts(hashes, bounds, index.lookup)
        edges = np.flatnonzero(np.diff(rows, prepend=-1, append=len(bounds)))
        keys, new = [], {}
        for begin, end in zip(edges, edges[1:], strict=False):
            key = hashlib.blake2b(terms[begin:end].tobytes() + counts[begin:end].tobytes(), digest_size=16).digest()
            keys.append((first + rows[begin], key))
            if key not in known and key not in new:
                new[key] = terms[begin:end], _vector(terms[begin:end], counts[begin:end], index.idf)
        if len(known) > 50_000:
            still = {key: known[key] for _, key in keys if key in known}
            known.clear()
            known.update(still)
        for key, near in zip(new, index.search(list(new.values()), k) if new else (), strict=True):
            vote = index.vote(*near)
            known[key] = (index.score(vote) if len(near[0]) else index.empty, vote, index.ids[near[0][:3]].tolist())
        for row, key in keys:
            out[row] = known[key]
    return out
