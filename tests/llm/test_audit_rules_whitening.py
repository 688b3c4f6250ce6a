"""Filter audit, quality rules and whitening against brute force and on odd rows."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import filter_audit, quality_rules, whitening

SCHEMA = "doc_id bigint, text string, source string, mask int, n bigint, part string, label int, digest string"
LABELS = "doc_id bigint, quality int, toxic int"
LONG = " ".join(f"w{i}" for i in range(60))


def _words(text):
    return re.findall("[^ \t\n\v\f\r]+", text or "")


def _documents(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, "p", 3, "d") for i, t, s in rows], SCHEMA).repartition(3)


DOCS = [(1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (3, LONG, "b"), (None, LONG, "b"), (4, "A $ B", None), (5, None, ""),
        (6, "", "a"), (7, "x " * 80, "a"), (8, LONG + " " + "QQ " * 9, "b"), (9, LONG + " | é😀 \v\x1f x", "c"), (10, LONG, "a"),
        (10, "other", "a"), (11, "é" * 3000, "c"), (12, " ".join(f"z{i}" for i in range(30_000)), "c")]
MARKS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (4, 1, 0), (None, 1, 1), (7, None, 1), (99, 1, 1)]


def _expected_audit():
    firsts = {}
    for i, text, _ in DOCS:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    good = {i for i, quality, _ in MARKS if quality == 1}
    toxic = {i for i, _, bad in MARKS if bad == 1}
    rows = []
    for i, text, source in DOCS:
        text, words = text or "", _words(text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                 "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": i is not None and i > firsts[text]}
        rows.append((source or "", {x for x in fails if fails[x]}, i is not None and i in good, i is not None and i in toxic))
    found, removed_by = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                failing = [r for r in own if letter in r[1]]
                removed_by[part, letter] += len(gone)
                found[part, "".join(order), step] = [
                    len(left), len(gone), len(failing) - len(gone), sum(r[1] == {letter} for r in failing),
                    sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {(part, order, step): (*v, removed_by[part, order[step - 1]]) for (part, order, step), v in found.items()}


def test_audit_against_brute_force(spark):
    masks = filter_audit.failure_masks(_documents(spark, DOCS), spark.createDataFrame(MARKS, LABELS))
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in filter_audit.audit(masks).collect()}
    assert got == _expected_audit()


def test_audit_without_rows(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(filter_audit.failure_masks(docs, labels)).count() == 0


def test_audit_of_other_filters(spark):
    masks = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 1, 1), ("p", 2, 4, 0, 0)],
                                  "part string, mask int, n bigint, good bigint, toxic bigint")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in filter_audit.audit(masks, "XY").collect()}
    assert rows == {("XY", 1): (9, 2, 0), ("XY", 2): (5, 4, 2), ("YX", 1): (5, 6, 0), ("YX", 2): (5, 0, 2)}
    with pytest.raises(ValueError):
        filter_audit.audit(masks, "XX")


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5])
def test_swaps_pass_through_every_order_and_keep_the_counts(size):
    rng = np.random.default_rng(size)
    counts = {mask: (int(n),) for mask, n in enumerate(rng.integers(0, 4, 2 ** size))}
    diagram = filter_audit.Diagram(counts, size, 1)
    orders = {tuple(diagram.order)}
    for level in filter_audit.adjacent_swaps(size):
        diagram.swap(level)
        orders.add(tuple(diagram.order))

        def read(node, depth, mask):
            if node is None:
                return {}
            if depth == size:
                return {mask: node.weight}
            return read(node.passed, depth + 1, mask) | read(node.failed, depth + 1, mask | 1 << diagram.order[depth])

        assert read(diagram.root, 0, 0) == {mask: n for mask, n in counts.items() if n[0]}
        for nodes in diagram.levels:
            assert len({(id(n.passed), id(n.failed)) for n in nodes.values()}) == len(nodes)
    assert len(orders) == math.factorial(size)


TEXTS = [None, "", " \n ", "a b c", "a b c a b c", "a a a a", LONG, LONG + "\n" + LONG, "x\nx\n \n\nx y\nx", "é😀 # $ <b>\nÉ É",
         " ".join(["p q"] * 40) + " r s", "y" * 40_000, " ".join(f"v{i % 9_000}" for i in range(20_000)), "a b\v\x0cc\rd a b c d"]


def test_statistics_against_brute_force(spark):
    docs = _documents(spark, [
        *((i, t, "s") for i, t in enumerate(TEXTS)), (None, "q", "s"), (3, "a b c", "s")])
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
                  for r in quality_rules.statistics(docs).collect())
    expected = Counter()
    for i, text in [*enumerate(TEXTS), (None, "q"), (3, "a b c")]:
        words, covered = _words(text), set()
        windows = Counter(zip(words, words[1:], words[2:]))
        for p in range(len(words) - 2):
            if windows[tuple(words[p:p + 3])] > 1:
                covered |= {p, p + 1, p + 2}
        lines = [x for x in (text or "").split("\n") if _words(x)]
        expected[i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
                 len(lines) - len(set(lines)), len(covered)] += 1
    assert got == expected


def _planted(spark, n=900):
    """Good: few symbols and long words, or very long; the rest is bad."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        words, symbols, chars = int(rng.integers(60, 400)), int(rng.integers(0, 90)), int(rng.integers(120, 3000))
        bad = symbols / words > 0.25 and chars / words < 7
        rows.append((i, int(not bad), words, chars, symbols))
    zeros = [F.lit(0).cast("bigint").alias(x) for x in quality_rules.COUNTS if x not in ("n_words", "word_chars", "n_symbols")]
    frame = spark.createDataFrame(rows, "doc_id bigint, quality int, n_words bigint, word_chars bigint, n_symbols bigint")
    return frame.select("*", *zeros)


def test_rules_find_a_planted_conjunction(spark):
    planted = _planted(spark)
    rules = quality_rules.fit(planted.drop("quality"), planted.select("doc_id", "quality"))
    assert rules.label == 0 and rules.rules
    assert {c.feature for rule in rules.rules for c in rule.conditions} >= {"symbols", "word_length"}
    judged = quality_rules.judge(planted, rules).collect()
    assert sum(r.kept == bool(r.quality) for r in judged) >= 0.93 * len(judged)
    assert all((r.rule > 0) != r.kept for r in judged if not r.base_failed)
    assert all(rule.right >= quality_rules.PRECISION * rule.covered for rule in rules.rules)
    again = quality_rules.fit(planted.drop("quality").repartition(7), planted.select("doc_id", "quality"))
    assert again == rules


def test_rules_without_both_labels(spark):
    planted = _planted(spark, 40)
    empty = quality_rules.fit(planted.drop("quality"), spark.createDataFrame([], LABELS))
    assert empty.rules == () and all(r.kept for r in quality_rules.judge(planted, empty).collect())
    bad = quality_rules.fit(planted.drop("quality"), planted.select("doc_id", F.lit(0).alias("quality")))
    assert not any(r.kept for r in quality_rules.judge(planted, bad).collect())
    assert quality_rules.statistics(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rules_need_no_python(spark):
    planted = _planted(spark, 40)
    rules = quality_rules.DecisionList((quality_rules.Rule((quality_rules.Condition("symbols", True, 0.2),), 1, 1),), 0)
    docs = _documents(spark, [(1, LONG, "s")])
    for frame in (quality_rules.statistics(docs), quality_rules.judge(planted, rules)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows],
                                 "vec_id bigint, embedding array<float>, n bigint, component int, x string").repartition(3)


def _check(rows, got, size):
    usable = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000) for i, v in rows
              if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    fitted = np.unique(np.stack([x for _, x in usable]), axis=0)
    n, sums = len(fitted), fitted.sum(axis=0)
    centred = fitted - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == len(usable) * min(size, 16)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, r)
    for i, x in usable:
        spread = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True))
        mine = by[i, spread]
        for k in range(min(size, 16)):
            r = mine[k + 1]
            assert r.n == n and r.explained == pytest.approx(values[k] / values.sum(), rel=1e-6, abs=1e-12)
            if values[k] > 1e-9 * values[0]:
                assert abs(r.whitened) == pytest.approx(abs((x - sums / n) @ vectors[:, k]) / math.sqrt(values[k]), abs=1e-6)
            assert r.identity_error <= 1e-6


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=20) * np.linspace(0.3, 3, 20)]) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]                      # copies count once
    rows += [(1, rows[5][1]), (None, rows[6][1]), (501, None), (502, []), (503, [float("nan")] * 20), (504, [None] * 20),
             (505, [1.0] * 7), (506, [float("inf")] + [0.0] * 19)]
    vectors = _vectors(spark, rows)
    _check(rows, whitening.whiten(vectors, whitening.fit(vectors)).collect(), 20)


def test_whitening_of_degenerate_tables(spark):
    empty = _vectors(spark, [])
    assert whitening.fit(empty) is None and whitening.whiten(empty, None).count() == 0
    same = _vectors(spark, [(i, [0.5, -2.0, 3.0]) for i in range(5)])
    rows = whitening.whiten(same, whitening.fit(same)).collect()
    assert len(rows) == 15 and all(r.whitened is None and r.explained == 0 and r.deviation == 0 and r.n == 1 for r in rows)
    flat = _vectors(spark, [(i, [float(i), float(i), 7.0]) for i in range(6)])   # one direction only
    rows = whitening.whiten(flat, whitening.fit(flat)).collect()
    assert {r.component for r in rows if r.whitened is not None} == {1}
    huge = _vectors(spark, [(i, [1e30 * (-1) ** i, float(i)]) for i in range(6)])
    rows = whitening.whiten(huge, whitening.fit(huge)).collect()
    assert len(rows) == 12 and all(r.deviation is None and r.identity_error < 1e-4 for r in rows)


@pytest.mark.parametrize("top", [0, 1, 300, 2 ** 20, 2 ** 33, 2 ** 59])
def test_sliced_products_are_exact(top):
    x = np.random.default_rng(top % 97).integers(0, top, (131, 5), endpoint=True)
    expected = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(5)] for i in range(5)]
    assert [[int(v) for v in row] for row in whitening.sliced_products(x)] == expected
