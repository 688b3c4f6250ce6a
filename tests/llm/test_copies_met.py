"""Copies of one original are joined where they can be similar, not wherever they share a difference."""

import numpy as np

from wardlight.llm import near_dedup


def _alike(x, y):
    return len(x & y) >= 0.8 * len(x | y) - 1e-9


def test_copies_of_one_original_meet_only_where_they_can_be_similar(spark):
    """Copies around the threshold with differences in common by chance: few pairs, no similar one lost."""
    rng = np.random.default_rng(7)
    center, sets = set(range(200)), [set(range(200))]
    for i in range(1, 240):
        gone = {int(at) + j for at in rng.choice(196, int(rng.integers(4, 7)), replace=False) for j in range(5)}
        sets.append(center - gone | {10_000 + 100 * i + j for j in range(len(gone))})
    for i in range(1, 60, 4):   # similar to one another, not to the original
        sets.append(sets[i] - {150 + i % 40} | {5000 + i})
    label = [0 if _alike(x, center) else i for i, x in enumerate(sets)]
    name = "{:05}".format
    beside = spark.createDataFrame(
        [(name(0).encode(), 200, name(i).encode(), len(x), name(label[i]).encode()) for i, x in enumerate(sets) if i],
        "leader binary, leader_size bigint, node binary, size bigint, label binary")
    table = spark.createDataFrame([(name(i).encode(), sorted(x)) for i, x in enumerate(sets)], "node binary, shingles array<bigint>")
    got = {tuple(sorted((int(r.a), int(r.b)))) for r in near_dedup._differing(spark, beside, table, 0.8).collect()}
    pairs = [(i, j) for i in range(1, len(sets)) for j in range(i + 1, len(sets)) if label[i] != label[j]]
    similar = {(i, j) for i, j in pairs if _alike(sets[i], sets[j])}
    assert len(similar) >= 5 and similar <= got
    assert len(got) < 100, (len(got), len(pairs), len(similar))
