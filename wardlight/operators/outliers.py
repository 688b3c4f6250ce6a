"""Isolation forest: small trees on bounded samples, scored over all rows in Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TREES = 100
SAMPLE = 256
NODE = "tree int, node int, feature int, cut double, low int, high int, size int"


def _expected_depth(n):
    """Mean depth of an unsuccessful search among n values."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m, out)


def tree_samples(rows: DataFrame, features, id_col: str, n_rows: int, trees: int, sample: int,
                 seed: int) -> DataFrame:
    """Per tree the ``sample`` rows of lowest hash.

    A first cut keeps a row only for the trees where its hash is small, so about
    ``4 * sample`` rows per tree are shuffled, whatever the table size.
    """
    share = min(1.0, 4.0 * sample / n_rows)
    limit = int(share * 2**63) - 1
    picked = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.shiftrightunsigned(
        F.xxhash64(F.col(id_col), t, F.lit(seed)), 1) <= limit)
    drawn = rows.select(id_col, *features, F.explode(picked).alias("tree"))
    w = Window.partitionBy("tree").orderBy(F.xxhash64(F.col(id_col), F.col("tree"), F.lit(seed)), id_col)
    return drawn.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= sample).select("tree", *features)


def _grow(features, seed: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["tree"].iloc[0])
        data = pdf[features].to_numpy(float)
        rng = np.random.default_rng([seed, number])
        limit = math.ceil(math.log2(max(len(data), 2)))
        nodes: list[list] = []
        waiting = [(data, 0, None)]
        while waiting:
            part, depth, parent = waiting.pop()
            index = len(nodes)
            nodes.append([number, index, -1, 0.0, -1, -1, len(part)])
            if parent is not None:
                nodes[parent[0]][parent[1]] = index
            spread = part.max(axis=0) - part.min(axis=0)
            usable = np.flatnonzero(spread > 0)
            if depth >= limit or len(part) <= 1 or len(usable) == 0:
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
            low = part[:, f] <= cut
            nodes[index][2:4] = [f, cut]
            waiting += [(part[low], depth + 1, (index, 4)), (part[~low], depth + 1, (index, 5))]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "low", "high", "size"])
    return build


def _depth_sum(data: np.ndarray, forest: list[dict]) -> np.ndarray:
    total = np.zeros(len(data))
    rows = np.arange(len(data))
    for t in forest:
        at = np.zeros(len(data), dtype=int)
        depth = np.zeros(len(data))
        while True:
            f = t["feature"][at]
            inner = f >= 0
            if not inner.any():
                break
            go_low = data[rows, np.maximum(f, 0)] <= t["cut"][at]
            at = np.where(inner, np.where(go_low, t["low"][at], t["high"][at]), at)
            depth += inner
        total += depth + _expected_depth(t["size"][at])
    return total


def isolation_forest(rows: DataFrame, features, id_col: str, trees: int = TREES, sample: int = SAMPLE,
                     seed: int = 42) -> DataFrame:
    """``outlier_score`` (0..1) and ``outlier`` (+1 above one half, else -1) per row.

    Needs ten rows. Each tree is grown in its own task on at most ``sample``
    rows; the node table (at most ``trees * 2 * sample`` small rows) goes to
    every scoring task.
    """
    features = list(features)
    n_rows = rows.count()
    if n_rows < 10:
        raise ValueError("at least 10 rows are needed")
    samples = tree_samples(rows, features, id_col, n_rows, trees, sample, seed)
    nodes = samples.groupBy("tree").applyInPandas(_grow(features, seed), NODE).toPandas()
    forest = []
    for _, part in nodes.sort_values(["tree", "node"]).groupby("tree"):
        forest.append({c: part[c].to_numpy() for c in ("feature", "cut", "low", "high", "size")})
    scale = len(forest) * float(_expected_depth(min(sample, n_rows)))
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = np.power(2.0, -_depth_sum(pdf[features].to_numpy(float), shared.value) / scale)
            yield pd.DataFrame({id_col: pdf[id_col], "outlier_score": s, "outlier": np.where(s > 0.5, 1, -1)})

    kind = dict(rows.dtypes)[id_col]
    return rows.select(id_col, *features).mapInPandas(
        score, f"{id_col} {kind}, outlier_score double, outlier int")
