"""Operator 7: near duplicates by DartMinHash signatures, banded joins and exact checks.

A weighted element is a region: its weight wide, infinitely high in rank. Darts fall
on regions at fixed places given by a hash, one per unit of area on average. Each dart
belongs to one coordinate of the signature, and the dart of lowest rank is that
coordinate's value; two sets agree in a coordinate with the probability of their
weighted Jaccard similarity. Only ranks up to what fills all coordinates are looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardlight.llm import textscan
from wardlight.llm.stored import store

WORDS = 5            # words of a shingle
SIMILARITY = 0.8
BANDS, ROWS = 24, 5  # at 0.8 a pair misses every band once in 15,000
_FINEST = 64         # the lowest cell of ranks is 1/64 high
_STARTS = np.array([0.0] + [2.0 ** i / _FINEST for i in range(7)])
_POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, i + 1))) for i in range(16)])


def _cell(number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest rank and height of cells: 1/64, 1/64, 1/32 ... 1/2, then 1 each."""
    low = np.where(number < 7, _STARTS[np.minimum(number, 7)], number - 6.0)
    high = np.where(number + 1 < 7, _STARTS[np.minimum(number + 1, 7)], number - 5.0)
    return low, high - low


def _unit(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def dart_signatures(elements: np.ndarray, weights: np.ndarray, bounds: np.ndarray, k: int) -> np.ndarray:
    """Signatures (rows x k) of weighted sets; set i has elements bounds[i]..bounds[i + 1].

    A set without weight has a row of zeros.
    """
    sets = len(bounds) - 1
    out = np.zeros((sets, k), np.uint64)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    total = np.bincount(owner, weights, minlength=sets)
    reach = (k * (np.log(k) + 3.0)) / np.maximum(total, 1e-12)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        open_ = np.zeros(sets, bool)
        open_[todo] = True
        pick = open_[owner] & (weights > 0)
        e, w, o = elements[pick], weights[pick], owner[pick]
        # A weight is cut into units; the last may be a fraction, which keeps that share of its darts.
        units = np.ceil(w).astype(np.int64)
        index = np.repeat(np.arange(len(e)), units)
        unit = np.arange(len(index)) - np.repeat(np.cumsum(units) - units, units)
        share = np.minimum(w[index] - unit, 1.0)
        base = textscan.mix(e[index] + textscan.mix(unit.astype(np.uint64) + np.uint64(1)))
        cells = np.where(reach < 1.0, np.searchsorted(_STARTS, reach, "left"), np.ceil(reach) + 6).astype(np.int64)
        count = np.maximum(cells, 1)[o[index]]
        which = np.repeat(np.arange(len(index)), count)
        number = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        seed = textscan.mix(base[which] + number.astype(np.uint64) * textscan.MULTIPLIER)
        low, height = _cell(number)
        u, darts, chance = _unit(seed), np.zeros(len(which), np.int64), np.exp(-height)
        below, term = chance.copy(), chance
        for i in range(1, 16):
            darts += u >= below
            term = term * height / i
            below = below + term
        at = np.repeat(np.arange(len(which)), darts)
        order = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = textscan.mix(seed[at] ^ textscan.mix(order.astype(np.uint64) + np.uint64(77)))
        rank = low[at] + height[at] * _unit(textscan.mix(dart + np.uint64(1)))
        inside = _unit(textscan.mix(dart + np.uint64(2))) < share[which[at]]
        own = o[index[which[at]]]
        inside &= rank < reach[own]
        dart, rank, own = dart[inside], rank[inside], own[inside]
        slot = own * k + (textscan.mix(dart + np.uint64(3)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((dart, rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        out.reshape(-1)[slot[first]] = dart[first]
        filled = np.bincount(slot[first] // k, minlength=sets)
        todo = todo[filled[todo] < k]
        reach[todo] *= 2.0   # a coordinate is still empty: look at higher ranks
    return out


def _shingles(hashes: np.ndarray, bounds: np.ndarray, width: int):
    """Distinct shingles of each row, ascending, with their counts; a shorter text is one shingle."""
    places, rows = textscan.window_rows(bounds, width)
    value = textscan.rolling(hashes, width)[places] if len(places) else np.zeros(0, np.uint64)
    for n in range(1, width):
        short = np.flatnonzero(np.diff(bounds) == n)
        if len(short):
            value = np.concatenate([value, textscan.rolling(hashes, n)[bounds[:-1][short]] + np.uint64(n)])
            rows = np.concatenate([rows, short])
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    first = np.flatnonzero((np.diff(rows, prepend=-1) != 0) | (np.diff(value, prepend=np.uint64(0)) != 0))
    counts = np.diff(np.append(first, len(rows)))
    return value[first], counts, np.searchsorted(rows[first], np.arange(len(bounds)))


def signatures(docs: DataFrame, width: int = WORDS, bands: int = BANDS, rows: int = ROWS,
               weighted: bool = False) -> DataFrame:
    """doc_id, text_hash, node (digest of the shingle set), size, keys (one per band)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, bounds in textscan.hashed_rows(batch.column(2), limit=1 << 18):
                values, counts, edges = _shingles(hashes, bounds, width)
                weights = counts.astype(float) if weighted else np.ones(len(values))
                found = dart_signatures(values, weights, edges, bands * rows)
                keys = found.reshape(-1, bands, rows)
                key = np.zeros(keys.shape[:2], np.uint64)
                for i in range(rows):
                    key = textscan.mix(key * textscan.MULTIPLIER + keys[:, :, i])
                key = textscan.mix(key + np.arange(bands, dtype=np.uint64))
                n = len(bounds) - 1
                sizes = np.diff(edges)
                totals = np.diff(np.concatenate([[0], np.cumsum(counts)])[edges]) if weighted else sizes
                body = values.view(np.uint8) if not weighted else np.stack([values, counts.astype(np.uint64)], 1).view(np.uint8).ravel()
                step = 16 if weighted else 8
                nodes = [hashlib.blake2b(body[edges[i] * step:edges[i + 1] * step], digest_size=16).digest()
                         if sizes[i] else None for i in range(n)]
                offsets = pa.array(np.arange(n + 1) * bands, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(nodes, pa.binary()),
                     pa.array(totals, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(key.ravel().view(np.int64)))],
                    names=["doc_id", "text_hash", "node", "size", "keys"])

    return docs.mapInArrow(scan, "doc_id bigint, text_hash bigint, node binary, size bigint, keys array<bigint>")


def shingle_sets(docs: DataFrame, width: int = WORDS, weighted: bool = False) -> DataFrame:
    """node and its shingle hashes, one row per row of ``docs`` (doc_id, text_hash, text).

    With weights, a shingle that occurs n times is n different elements.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, hashes, bounds in textscan.hashed_rows(batch.column(1)):
                values, counts, edges = _shingles(hashes, bounds, width)
                if weighted:
                    index = np.repeat(np.arange(len(values)), counts)
                    turn = np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)
                    values = textscan.mix(values[index] + turn.astype(np.uint64))
                    edges = np.concatenate([[0], np.cumsum(counts)])[edges]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(bounds) - 1),
                     pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values.view(np.int64)))],
                    names=["node", "shingles"])

    return docs.mapInArrow(scan, "node binary, shingles array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """node and label, the least node it is linked to, for every node of ``edges`` (a, b).

    Each round a node takes the least label among its own, its neighbours' and that of
    its label, so long chains shorten by doubling; every round is a stored table.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = store(spark, both.distinct(), "near-edges")
    labels = store(spark, both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.first("a")).alias("label")), "near-labels")
    while True:
        near = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        stepped = labels.join(near, "node").join(up, "label").select(
            "node", F.least("label", "near", "far").alias("label"),
            (F.least("label", "near", "far") != F.col("label")).alias("changed"))
        labels = store(spark, stepped, "near-labels")
        if labels.filter("changed").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = WORDS, bands: int = BANDS,
                    rows: int = ROWS, weighted: bool = False, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, class_id, class_size, n_links, class_node.

    Sets of ``width``-word shingles (words parted by space and \\t \\n \\v \\f \\r; a shorter
    text is one shingle) are linked at Jaccard similarity ``similarity`` or more; with
    ``weighted``, shingles count as often as they occur. A class holds what links
    connect; class_id is its smallest doc_id, class_node the node it is
    named by (null without words). n_links counts the checked links of the
    row's shingle set. Texts of equal sets are one node, so copies are never paired. A
    null text, or one without words, is a class of its own. Null ids are sorted last
    in a class, alone they give a null class_id; rows that repeat an id count in class_size. Extra columns
    are not read; an empty table gives an empty result.

    Pairs that share a band are candidates. A band's bucket is not paired off: each
    member meets two leaders, the most central one (whose buckets are the largest) and one
    chosen by a hash per bucket. The pair that shares
    most bands per member is checked first, then the others that are not yet in one class. In a
    bucket whose classes still differ, members meet where they share what sets them off from the
    central one (``_differing``), which no similar pair fails to do. Every link is checked exactly.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"),
                         F.col(text_col).cast("string").alias("text"))
    rows_ = store(spark, signatures(source, width, bands, rows, weighted), "near-signatures")
    placed = rows_.filter("node IS NOT NULL").select("node", "size", F.explode("keys").alias("key"))
    members = placed.groupBy("key", "node").agg(F.max("size").alias("size"))
    counts = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = store(spark, members.join(counts, "key").select("key", "node", "size", "n"), "near-buckets")
    central = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    weighed = shared.join(central, "node").select("key", "node", "size", "weight")
    leaders = weighed.groupBy("key").agg(
        F.max(F.struct("weight", "node", "size")).alias("central"),
        F.min(F.struct(F.xxhash64("key", "node").alias("h"), "node", "size")).alias("other"))
    leaders = store(spark, leaders.select("key", F.struct("central.node", "central.size").alias("central"),
                                          F.struct("other.node", "other.size").alias("other")), "near-leaders")
    both = leaders.select("key", F.explode(F.array("central", "other")).alias("leader"))
    met = shared.join(both.select("key", F.col("leader.node").alias("leader"),
                                  F.col("leader.size").alias("leader_size")), "key")

    wanted = shared.select("node").distinct()
    best = rows_.join(wanted, "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"))
    texts = source.alias("s").join(
        best.select("node", F.col("at.doc_id").alias("d"), F.col("at.text_hash").alias("h")),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("node", "text")
    sets = store(spark, shingle_sets(texts, width, weighted).dropDuplicates(["node"]), "near-sets")

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar enough."""
        right = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        joined = right.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        both = F.size(F.array_intersect("x", "y"))
        return joined.filter(both >= F.lit(similarity) * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")

    fits = F.least("size", "leader_size") >= F.greatest("size", "leader_size") * similarity
    pairs = met.filter((F.col("node") != F.col("leader")) & fits).groupBy("leader", "node").agg(F.count("*").alias("n"))
    pairs = store(spark, pairs.select(F.col("leader").alias("a"), F.col("node").alias("b"), "n"), "near-pairs")
    top = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("t")).select(F.col("t.a").alias("a"), "b")
    links = store(spark, checked(top), "near-links")
    labels = components(links)
    rest = _apart(pairs, labels).join(top, ["a", "b"], "left_anti")
    links = links.unionByName(store(spark, checked(rest), "near-links"))
    labels = components(links)

    # Buckets whose members are still apart: their members beside the central one.
    mixed = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = mixed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
    beside = mixed.join(split.select("key"), "key").join(leaders.select("key", "central.*").toDF(
        "key", "leader", "leader_size"), "key").filter("node != leader")
    beside = beside.select("leader", "leader_size", "node", "size", "label").distinct()
    rest = _differing(spark, beside, sets, similarity).join(pairs, ["a", "b"], "left_anti")
    last = store(spark, checked(rest), "near-links")
    if not last.isEmpty():
        links = links.unionByName(last)
        labels = components(links)

    degree = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().groupBy(
        F.col("a").alias("node")).agg(F.count("*").alias("n_links"))
    nodes = rows_.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    nodes = nodes.join(labels, "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    nodes = store(spark, nodes, "near-nodes")
    classes = nodes.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    nodes = nodes.join(classes, "label").select("node", F.col("label").alias("class_node"), "class_id", "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows_.join(nodes, "node", "left").select(
        "doc_id", "text_hash", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "class_node")


def _differing(spark: SparkSession, beside: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different labels, among the nodes beside one leader, that can be similar.

    Two nodes of different labels are not both similar to their leader L, and then what they have in
    common must show in what sets them off from L. With d(x) the elements in just one of x and
    L, and r = (1 - similarity) / (1 + similarity), x and y are similar if d(x) and d(y) share at least
    (|d(x)| + |d(y)| - r (|x| + |y|)) / 2 elements, and y is unlike L if |d(y)| > r (|y| + |L|). So
    with an unlike partner, x must share more than (|d(x)| + r (|L| - |x|)) / 2 elements, about half of d(x), and
    with any partner (|d(x)| - r (|x| + |L|)) / 2. A node that is far, with less than ``similarity`` of its
    own elements in L, shares similarity * |x| - |x and L| elements outside L with every similar
    one, so for it these alone are looked at. Elements that only one label has meet nothing;
    of the others a node needs those rarest ones that leave fewer than it must share. A pair met there
    must share, by the sizes and distances of its own two sets, (|d(x)| + |d(y)| - r (|x| + |y|)) / 2 elements, or
    similarity / (1 + similarity) * (|x| + |y|) less what both can have in L of those outside L, and goes
    on if the elements before, at and after those it shares leave room for that many. So a
    large group around one leader is joined on the few differences its members share, not paired off.
    """
    own = sets.select("node", "shingles")
    from_leader = sets.select(F.col("node").alias("leader"), F.col("shingles").alias("of_leader"))
    placed = beside.join(own, "node").join(from_leader, "leader").select(
        "leader", "node", "label", "size", F.size("shingles").alias("n"), F.size("of_leader").alias("l"),
        F.array_except("shingles", "of_leader").alias("outside"), F.array_except("of_leader", "shingles").alias("missing"))
    ratio = (1 - similarity) / (1 + similarity)
    n, size, inside = F.col("n"), F.col("l"), F.col("n") - F.size("outside")
    apart = F.size("outside") + F.size("missing")
    far, linked = inside < similarity * n - 1e-9, apart <= ratio * (n + size) + 1e-9
    differences = F.concat("outside", "missing")

    def use(kind: int, elements: Column, need: Column, marked: Column) -> Column:
        """Elements to meet by, how many must be shared, whether the node is marked: far (0) or linked (2), and
        how many of its elements the leader has (0), or how many set them apart."""
        return F.struct(F.lit(kind).alias("kind"), elements.alias("elements"), F.greatest(
            F.ceil(need - 1e-9), F.lit(1)).alias("need"), marked.alias("marked"), (apart if kind else inside).alias("w"))

    half, least = (apart + ratio * (size - n)) / 2, (apart - ratio * (n + size)) / 2
    uses = F.array(use(0, F.col("outside"), F.when(far, similarity * n - inside).otherwise(1.0), far),   # with a far one
                   F.when(~far & ~linked, use(1, differences, half, linked)),                     # two unlike ones
                   F.when(~far, use(2, differences, F.when(linked, half).otherwise(least), linked)))  # a linked and an unlike one
    used = placed.select("leader", "node", "label", "size", F.explode(F.filter(uses, lambda u: u.isNotNull())).alias("u"))
    rows = store(spark, used.select("leader", "node", "label", "size", "u.kind", "u.need", "u.marked", "u.w",
                                    F.explode("u.elements").alias("element")), "near-differences")
    at = ["leader", "kind", "element"]
    common = rows.groupBy(*at).agg(
        F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("marked").alias("some"),
        F.min("marked").alias("every")).filter("lo != hi AND (kind = 1 OR some AND (kind = 0 OR NOT every))")
    member = Window.partitionBy("leader", "kind", "node")
    kept = rows.join(common.select(*at, "c"), at).withColumn("m", F.count("*").over(member)).withColumn(
        "turn", F.row_number().over(member.orderBy("c", "element"))).filter(F.col("turn") <= F.col("m") - F.col("need") + 1)
    columns = ["node", "label", "size", "marked", "w", "turn", "m"]
    kept = store(spark, kept.select(*at, *columns), "near-rarest")
    other = kept.select(*at, *[F.col(c).alias(f"{c}_b") for c in columns])
    fits = F.least("size", "size_b") >= F.greatest("size", "size_b") * similarity
    wanted = F.when(F.col("kind") == 0, F.col("marked") | F.col("marked_b")).otherwise(
        (F.col("kind") == 1) | (F.col("marked") != F.col("marked_b")))
    both = F.col("size") + F.col("size_b")
    must = F.when(F.col("kind") == 0, both * (similarity / (1 + similarity)) - F.least("w", "w_b")).otherwise(
        (F.col("w") + F.col("w_b") - both * ratio) / 2) - 1e-9
    after = F.least(F.col("m") - F.col("turn"), F.col("m_b") - F.col("turn_b"))
    room = F.least("turn", "turn_b") + after >= must
    met = kept.join(other, at).filter((F.col("label") < F.col("label_b")) & fits & wanted & room)
    # Up to the last element met a pair shares just those counted, and after it at most the shorter rest.
    pairs = met.groupBy("leader", "kind", "node", "node_b").agg(
        F.count("*").alias("shared"), F.min(after - F.ceil(must)).alias("spare")).filter("shared + spare >= 0")
    return pairs.select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one class yet."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").filter(
        F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns: of each class the one row with the smallest id stays.

    Rows without words all stay. Rows that repeat both id and text are one row here.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    found = near_duplicates(docs, **options)
    first = found.filter("class_node IS NOT NULL").groupBy("class_node").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("f")).select("f.doc_id", "f.text_hash")
    stay = first.unionByName(found.filter("class_node IS NULL").select("doc_id", "text_hash")).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    hashed = docs.withColumn("_text_hash", F.xxhash64(text_col)).withColumn("_key", F.col(id_col).cast("bigint"))
    kept = hashed.join(stay, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left_semi")
    return kept.dropDuplicates(["_key", "_text_hash"]).select(*docs.columns)
