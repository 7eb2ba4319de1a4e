"""Isolation forest: trees grown from small samples, scores computed in a vectorised function."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlwarden.operators.quantiles import exact_quantiles
from urlwarden.session import materialise

TREES = 100
SAMPLE = 256
NODE = "tree int, node int, feature int, threshold double, left int, right int, depth double"


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow_tree(seed: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        x = np.stack(pdf.sort_values("id")["vec"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(2, len(x)))))
        nodes, todo = [], [(0, np.arange(len(x)), 0)]
        n_nodes = 1
        while todo:
            node, rows, depth = todo.pop()
            part = x[rows]
            wide = np.flatnonzero(part.min(axis=0) < part.max(axis=0))
            if depth >= limit or len(rows) <= 1 or not len(wide):
                nodes.append((tree, node, -1, 0.0, -1, -1, depth + float(_mean_path(len(rows)))))
                continue
            f = int(rng.choice(wide))
            cut = rng.uniform(part[:, f].min(), part[:, f].max())
            below = part[:, f] <= cut
            nodes.append((tree, node, f, cut, n_nodes, n_nodes + 1, 0.0))
            todo += [(n_nodes, rows[below], depth + 1), (n_nodes + 1, rows[~below], depth + 1)]
            n_nodes += 2
        names = [c.split()[0] for c in NODE.split(", ")]
        return pd.DataFrame(nodes, columns=names)
    return run


@dataclass
class IsolationForest:
    """``nodes``: at most TREES * (2 * SAMPLE - 1) rows; ``offset``: scores below are outliers;
    ``scored``: the scores (id, score) of the rows it was fitted on."""
    nodes: pd.DataFrame
    sample: int
    offset: float | None = None
    scored: DataFrame | None = None

    def score(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        """Add ``score`` in [-1, 0): the lower, the easier a row is isolated."""
        trees = [t.sort_values("node")[["feature", "threshold", "left", "right", "depth"]].to_numpy()
                 for _, t in self.nodes.groupby("tree")]
        shared = df.sparkSession.sparkContext.broadcast(trees)
        norm = float(_mean_path(self.sample)) or 1.0

        @F.pandas_udf("double")
        def path_score(vecs: pd.Series) -> pd.Series:
            if not len(vecs):
                return pd.Series([], dtype="float64")
            x = np.stack(vecs.to_numpy())
            rows = np.arange(len(x))
            total = np.zeros(len(x))
            for t in shared.value:
                at = np.zeros(len(x), dtype="int64")
                feature = t[:, 0].astype("int64")
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    below = x[rows, np.maximum(f, 0)] <= t[at, 1]
                    at = np.where(inner, np.where(below, t[at, 2], t[at, 3]).astype("int64"), at)
                total += t[at, 4]
            return pd.Series(-np.power(2.0, -total / (len(shared.value) * norm)))

        return df.withColumn("score", path_score(vec))

    def inliers(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        """Add ``is_inlier`` by the fitted offset."""
        return self.score(df, vec).withColumn("is_inlier", F.col("score") >= F.lit(self.offset))


def fit_forest(df: DataFrame, contamination: float = 0.02, trees: int = TREES, seed: int = 42) -> IsolationForest:
    """Fit on (id, vec). Each tree draws its SAMPLE rows by hash from the whole table.

    The scores of the table are written once; the threshold is taken from them, and they stay at
    hand in ``scored`` (id, score).
    """
    n = df.count()
    limit = int(min(1.0, 2 * SAMPLE / n) * (1 << 30)) + 1
    seen_by = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                       lambda t: F.pmod(F.xxhash64("id", t, F.lit(seed)), F.lit(1 << 30)) < limit)
    drawn = df.select("id", "vec", F.explode(seen_by).alias("tree"))
    by_hash = Window.partitionBy("tree").orderBy(F.pmod(F.xxhash64("id", "tree", F.lit(seed)), F.lit(1 << 30)), "id")
    drawn = drawn.withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= SAMPLE)
    nodes = drawn.groupBy("tree").applyInPandas(_grow_tree(seed), NODE).toPandas()
    forest = IsolationForest(nodes, min(SAMPLE, n))
    forest.scored = materialise(forest.score(df).select("id", "score"), "forest-scores")
    forest.offset = exact_quantiles(forest.scored, ["score"], [contamination])["score"][0]
    return forest
