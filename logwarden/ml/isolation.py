"""Isolation forest (Liu, Ting and Zhou, ICDM 2008).

Every tree needs only a sample of 256 rows, so trees are grown in parallel from
a small pool; the forest (at most trees x 511 nodes) is sent to the executors,
where a vectorised function scores rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import pandas_udf

SAMPLE = 256
TREE = "tree int, n int, f array<int>, cut array<double>, l array<int>, r array<int>, d array<double>"


@dataclass
class Forest:
    """Trees, and the score above which a row is odd, learnt once on the training rows."""

    trees: list[dict]
    cut: float


def mean_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of n keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (feature, cut, left, right, depth value); feature -1 is a leaf."""
    limit, nodes = math.ceil(math.log2(max(len(x), 2))), []
    todo = [(np.arange(len(x)), 0, -1, False)]
    while todo:
        rows, depth, parent, right = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][3 if right else 2] = me
        part = x[rows]
        low, high = (part.min(axis=0), part.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            nodes.append([-1, 0.0, -1, -1, depth + mean_depth(len(rows))])
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        nodes.append([f, cut, -1, -1, 0.0])
        goes_left = part[:, f] <= cut
        todo.append((rows[goes_left], depth + 1, me, False))
        todo.append((rows[~goes_left], depth + 1, me, True))
    return nodes


def sampled(rows: DataFrame, key: str, trees: int, seed: int) -> DataFrame:
    """(tree, x): up to 256 rows per tree, drawn by hash so that a rerun draws the same."""
    n = rows.count()
    pool_share = min(1.0, SAMPLE * trees * 2 / max(n, 1))
    pool_size = n * pool_share
    tree_share = min(1.0, SAMPLE * 1.5 / max(pool_size, 1.0))

    def below(share: float, *parts):
        return F.pmod(F.xxhash64(*parts), F.lit(1_000_000_007)) < F.lit(int(share * 1_000_000_007))

    pool = rows.filter(below(pool_share, F.col(key), F.lit(seed)))
    drawn = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).filter(
        below(tree_share, F.col(key), F.col("tree"), F.lit(seed + 1))
    )
    order = Window.partitionBy("tree").orderBy(F.xxhash64(key, "tree", F.lit(seed + 2)), key)
    return drawn.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= SAMPLE).select("tree", "x")


def fit(rows: DataFrame, key: str = "id", trees: int = 100, seed: int = 42, contamination: float = 0.1) -> Forest:
    """Grow the forest from rows (key, x array<double>), one small dict per tree; ``contamination`` of the rows lie above its cut."""

    def tree(pdf: pd.DataFrame) -> pd.DataFrame:
        no = int(pdf["tree"].iloc[0])
        x = np.vstack(pdf["x"].to_numpy())
        nodes = grow(x, np.random.default_rng(seed * 1000 + no))
        cols = list(zip(*nodes))
        return pd.DataFrame({"tree": [no], "n": [len(x)], "f": [list(cols[0])], "cut": [list(cols[1])], "l": [list(cols[2])], "r": [list(cols[3])], "d": [list(cols[4])]})

    found = sampled(rows, key, trees, seed).groupBy("tree").applyInPandas(tree, TREE).collect()
    forest = Forest([r.asDict() for r in sorted(found, key=lambda r: r["tree"])], 1.0)
    cut = with_scores(rows, forest).agg(F.percentile_approx("anomaly_score", 1 - contamination, 10000).alias("c")).first()["c"]
    return Forest(forest.trees, 1.0 if cut is None else cut)


def save(forest: Forest, path: str, spark: SparkSession) -> None:
    """A row per tree, each with the cut."""
    rows = [(t["tree"], t["n"], t["f"], t["cut"], t["l"], t["r"], t["d"], forest.cut) for t in forest.trees]
    spark.createDataFrame(rows, f"{TREE}, limit double").coalesce(1).write.mode("overwrite").parquet(path)


def load(path: str, spark: SparkSession) -> Forest:
    rows = [r.asDict() for r in spark.read.parquet(path).orderBy("tree").collect()]
    return Forest(rows, rows[0]["limit"] if rows else 1.0)


def walkable(tree: dict) -> tuple[np.ndarray, ...]:
    """Feature, cut, children (right at 2 * node, left behind it), depth value and leaf mark per node; a leaf leads to itself."""
    f, own = np.asarray(tree["f"]), np.arange(len(tree["f"]))
    leaf = f < 0
    kids = np.stack([np.where(leaf, own, tree["r"]), np.where(leaf, own, tree["l"])], axis=1).ravel()
    return np.where(leaf, 0, f).astype(np.intp), np.asarray(tree["cut"]), kids.astype(np.intp), np.asarray(tree["d"]), leaf


def with_scores(rows: DataFrame, forest: Forest, out: str = "anomaly_score") -> DataFrame:
    """Add the anomaly score 2^(-mean depth / c(sample)); near 1 is odd."""
    shared = rows.sparkSession.sparkContext.broadcast([walkable(t) for t in forest.trees])
    scale = float(np.mean([mean_depth(t["n"]) for t in forest.trees])) or 1.0

    @pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        m = np.vstack(x.to_numpy())
        values, row = m.ravel(), np.arange(len(m)) * m.shape[1]
        total = np.zeros(len(m))
        for f, cut, kids, depth, leaf in shared.value:
            node = np.zeros(len(m), dtype=np.intp)
            while not leaf.take(node).all():
                left = values.take(row + f.take(node)) <= cut.take(node)
                node = kids.take(2 * node + left)
            total += depth.take(node)
        return pd.Series(np.power(2.0, -total / len(shared.value) / scale))

    return rows.withColumn(out, score("x"))


def flag_anomalies(scored: DataFrame, forest: Forest, score: str = "anomaly_score") -> DataFrame:
    """Mark rows above the forest's cut; a row's mark does not depend on the rows scored with it."""
    return scored.withColumn("is_anomaly", F.col(score) > F.lit(forest.cut))
