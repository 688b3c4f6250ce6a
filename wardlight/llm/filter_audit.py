"""Operator 11: how filters interact, by decision diagrams of failure masks.

Every document has a mask of the filters it fails. Masks are counted per part (a source)
before any shuffle; a part has at most 2 ** filters of them. Over these counts a
decision diagram is built: one level a filter, equal subgraphs shared, empty ones left
out, every node weighted with the documents below it. Swapping two adjacent levels
rewrites only these two, and adjacent swaps alone pass through all orders of the
filters (plain changes). In each order the path on which every filter passes gives the
steps: the weight of the failing child is what a step removes, that of the passing
child what it keeps.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.stored import store

# Fixed values of the five standard filters.
LETTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65   # percent of the words
MOST_CAPITALS = 5     # percent of the code points
SYMBOLS = r"[#$%&*|]"
BLANK = " \t\n\x0b\x0c\r"

STEP_SCHEMA = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
               "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


class Node:
    """A weighted node; ``failed`` and ``passed`` are None where no document goes."""

    __slots__ = ("failed", "passed", "weight")

    def __init__(self, passed, failed, weight):
        self.passed, self.failed, self.weight = passed, failed, weight


class Diagram:
    """Counts of failure masks as a diagram whose levels follow ``order`` (bit numbers)."""

    def __init__(self, counts: dict[int, tuple[int, ...]], size: int, width: int):
        self.order = list(range(size))
        self.nothing = (0,) * width
        self.levels: list[dict] = [{} for _ in range(size)]
        leaves: dict = {}

        def grow(level: int, masks: dict[int, tuple[int, ...]]):
            if not masks:
                return None
            if level == size:
                (weight,) = masks.values()
                return leaves.setdefault(weight, Node(None, None, weight))
            halves: tuple[dict, dict] = ({}, {})
            for mask, weight in masks.items():
                halves[mask >> level & 1][mask] = weight
            return self._node(level, grow(level + 1, halves[0]), grow(level + 1, halves[1]))

        self.root = grow(0, {mask: weight for mask, weight in counts.items() if any(weight)})

    def weight(self, node: Node | None) -> tuple[int, ...]:
        return node.weight if node else self.nothing

    def _node(self, level: int, passed: Node | None, failed: Node | None) -> Node | None:
        if passed is None and failed is None:
            return None
        key = (id(passed), id(failed))
        if key not in self.levels[level]:
            both = tuple(a + b for a, b in zip(self.weight(passed), self.weight(failed), strict=True))
            self.levels[level][key] = Node(passed, failed, both)
        return self.levels[level][key]

    def swap(self, level: int) -> None:
        """Exchange a level with the next. Nodes above and below the two stay as they are."""
        upper = list(self.levels[level].values())
        self.levels[level], self.levels[level + 1] = {}, {}
        for node in upper:
            old = [(child.passed, child.failed) if child else (None, None) for child in (node.passed, node.failed)]
            node.passed = self._node(level + 1, old[0][0], old[1][0])
            node.failed = self._node(level + 1, old[0][1], old[1][1])
            self.levels[level][id(node.passed), id(node.failed)] = node
        self.order[level:level + 2] = self.order[level + 1], self.order[level]

    def path(self) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """(kept, removed) weights of each step on the path on which all filters pass."""
        steps, node = [], self.root
        for _ in self.order:
            failed, node = (node.failed, node.passed) if node else (None, None)
            steps.append((self.weight(node), self.weight(failed)))
        return steps


def adjacent_swaps(size: int) -> list[int]:
    """Levels to swap, one after the other, to pass through every order once."""
    if size < 2:
        return []
    inner = adjacent_swaps(size - 1)
    down, up = list(range(size - 2, -1, -1)), list(range(size - 1))
    found = list(down)
    for i, at in enumerate(inner):   # the last filter stands at the top after a way down, at the bottom after a way up
        found += [at + 1, *up] if i % 2 == 0 else [at, *down]
    return found


def audit_counts(counts: dict[int, tuple[int, int, int]], letters: str = LETTERS) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step."""
    diagram = Diagram(counts, len(letters), 3)
    walks = [("".join(letters[bit] for bit in diagram.order), diagram.path())]
    for level in adjacent_swaps(len(letters)):
        diagram.swap(level)
        walks.append(("".join(letters[bit] for bit in diagram.order), diagram.path()))
    fails, alone, shapley = {}, {}, dict.fromkeys(letters, 0)
    for order, steps in walks:
        for letter, (_, removed) in zip(order, steps, strict=True):
            shapley[letter] += removed[0]
        fails[order[0]] = steps[0][1][0]     # first: all that fail the filter
        alone[order[-1]] = steps[-1][1][0]   # last: all that fail no other
    return [(order, i + 1, kept[0], removed[0], fails[letter] - removed[0], alone[letter], removed[1], removed[2], shapley[letter])
            for order, steps in walks for i, (letter, (kept, removed)) in enumerate(zip(order, steps, strict=True))]


def standard_failures(text: Column) -> list[Column]:
    """Whether the text fails filters A to D; E (an earlier equal text) needs the whole table."""
    trimmed = F.btrim(text, F.lit(BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    counts = F.transform(F.array(words), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct")))[0]
    return [counts, F.lit(100) * capitals.cast("bigint") > F.lit(MOST_CAPITALS) * F.length(text), F.rlike(text, F.lit(SYMBOLS))]


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: rows of each part by the filters failed (bit 0 is A).

    A null text is empty (it fails A only, and E where an earlier row is empty too), a null
    source is the empty string. Rows with one id are rows of their own; equal rows with the
    same id do not make each other repeats, as neither id is smaller; a row without an id
    is never a repeat, nor is any other because of it. good and toxic count rows whose id
    any row of ``labels`` marks with quality or toxic 1. Extra columns are not read.

    Texts are compared by SHA-256. The texts are read once; what is shuffled is an id, a
    digest, a part and a mask for each. The first row of a text is joined on (digest, id), so copies
    of one text spread over all tasks.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counts, capitals, symbols = standard_failures(text)
    bits = [F.col("counts.n") < LEAST_WORDS, F.lit(100) * F.col("counts.distinct") < F.lit(LEAST_DISTINCT) * F.col("counts.n"),
            F.col("capitals"), F.col("symbols")]
    facts = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), counts.alias("counts"), capitals.alias("capitals"), symbols.alias("symbols"))
    facts = facts.select("id", "part", "digest", sum(
        (bit.cast("int") * (1 << i) for i, bit in enumerate(bits)), F.lit(0)).alias("mask"))
    facts = store(docs.sparkSession, facts, "audit-facts")
    first = facts.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = facts.join(first, ["digest", "id"], "left").join(marks, "id", "left")
    repeat = F.col("first").isNull() & F.col("id").isNotNull()
    return rows.groupBy("part", (F.col("mask") + repeat.cast("int") * 16).alias("mask")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


def audit(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the counted masks of ``failure_masks``.

    ``letters`` names the bits of ``mask``; other filters than the standard ones bring their own
    masks. Every part has all orders and steps, zeros included; without rows there are no parts.
    Parts are independent: each is one row of at most 2 ** len(letters) counts when the diagrams are built.
    """
    if len(set(letters)) != len(letters):
        raise ValueError("filters need different letters")
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    columns = [field.split()[0] for field in STEP_SCHEMA.split(", ")]

    def steps(frames):
        for frame in frames:
            for part, counts in zip(frame["part"], frame["counts"], strict=True):
                weights = {row["mask"]: (row["n"], row["good"], row["toxic"]) for row in counts}
                yield pd.DataFrame([(part, *row) for row in audit_counts(weights, letters)], columns=columns)

    return parts.mapInPandas(steps, STEP_SCHEMA)
