"""Extra-trees: trees over all rows whose cuts are drawn at random inside each node.

All trees grow level by level together. A level takes two aggregates over (tree, node): the range
of each feature, then the classes below each drawn cut. Draws are prefixes of SHA-256 over seed,
tree, node and feature, so a forest depends on the rows alone, not on how they are dealt.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlwarden.session import materialise

SPLIT = ["tree", "node", "feature", "cut", "n", "pos"]


def draw(*parts: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of a hash of the parts."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


@dataclass
class ExtraTrees:
    """``nodes``: tree, node (children of i are 2 i and 2 i + 1, the root is 1), feature (-1 in a leaf),
    cut (rows at most the cut go to 2 i), n and pos (weight of all and of positive rows). There are
    at most trees * 2^(depth + 1) nodes."""

    nodes: pd.DataFrame
    trees: int
    features: list[str]

    def _tables(self) -> list[tuple[np.ndarray, ...]]:
        """Per tree its sorted nodes with feature, cut and share of positives."""
        out = []
        for _, t in self.nodes.sort_values(["tree", "node"]).groupby("tree"):
            out.append((t["node"].to_numpy(), t["feature"].to_numpy(), t["cut"].to_numpy(), (t["pos"] / t["n"]).to_numpy()))
        return out

    def _walk(self, df: DataFrame, schema: str, finish) -> Column:
        shared = df.sparkSession.sparkContext.broadcast(self._tables())

        @F.pandas_udf(schema)
        def walk(vecs: pd.Series) -> pd.Series:
            if not len(vecs):
                return pd.Series([], dtype="object")
            x = np.stack(vecs.to_numpy()).astype("float64")
            rows, ends = np.arange(len(x)), []
            for names, feature, cut, share in shared.value:
                name = np.ones(len(x), dtype="int64")
                while True:
                    at = np.searchsorted(names, name)
                    known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == name)
                    at = np.where(known, at, 0)
                    inner = known & (feature[at] >= 0)
                    if not inner.any():
                        break
                    right = x[rows, np.maximum(feature[at], 0)] > cut[at]
                    name = np.where(inner, 2 * name + right, name)
                ends.append(finish(name, known, share[at]))
            return pd.Series(list(np.stack(ends, axis=1)))

        return walk("_vec")

    def score(self, df: DataFrame, out: str = "probability") -> DataFrame:
        """Add the mean share of positives over the leaves of all trees; a null feature counts as 0."""
        if not len(self.nodes):
            return df.withColumn(out, F.lit(None).cast("double"))
        with_vec = df.withColumn("_vec", _vector(self.features))
        shares = self._walk(df, "array<double>", lambda name, known, share: share)
        total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
        return with_vec.withColumn(out, total / self.trees).drop("_vec")


def _vector(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])


def fit_extra_trees(df: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 100,
                    depth: int = 12, tried: int | None = None, seed: int = 42) -> ExtraTrees:
    """Fit on all rows of df. A node tries the first ``tried`` (default: root of their number) of its
    features that vary, in the order of a hash, each at one cut drawn evenly from its range there, and
    takes that of the least Gini impurity; the earlier one of equal ones. A node of one class, without a
    varying feature or at ``depth`` is a leaf. A null label or feature counts as 0; repeated rows weigh
    as often as they occur. An empty table gives trees without nodes, whose score is null."""
    tried = tried or max(1, int(len(features) ** 0.5))
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    y = F.coalesce(F.col(label).cast("double"), F.lit(0.0))
    # Equal rows are one row with their weight: a hot row costs no more than others.
    rows = df.select(_vector(features).alias("_vec"), (w * y).alias("p"), w.alias("w"))
    rows = materialise(rows.groupBy("_vec").agg(F.sum("w").alias("w"), F.sum("p").alias("p")), "forest-rows")
    model = ExtraTrees(pd.DataFrame([], columns=SPLIT), trees, features)
    done: list[pd.DataFrame] = []
    for level in range(depth + 1):
        if level:
            ends = model._walk(rows, "array<long>", lambda name, known, share: np.where(known, -1, name))
        else:
            ends = F.array_repeat(F.lit(1).cast("long"), trees)
        placed = rows.select("_vec", "w", "p", F.posexplode(ends).alias("tree", "node")).where("node > 0")
        at = _level(placed, features, tried, seed, level == depth)
        if not len(at):
            break
        done.append(at)
        model.nodes = pd.concat(done, ignore_index=True)
    return model


def _level(placed: DataFrame, features: list[str], tried: int, seed: int, last: bool) -> pd.DataFrame:
    """The nodes of one level with the cut each takes: at most trees * 2^level rows."""
    key = ["tree", "node"]
    total = [F.sum("w").alias("n"), F.sum("p").alias("pos")]
    if last:
        found = placed.groupBy(*key).agg(*total).withColumns({"feature": F.lit(-1), "cut": F.lit(0.0)})
        return found.select(*SPLIT).toPandas()
    vec = F.col("_vec")
    each = [F.struct(F.min(vec[i]).alias("lo"), F.max(vec[i]).alias("hi")) for i in range(len(features))]
    ranges = placed.groupBy(*key).agg(*total, F.array(*each).alias("ranges"))
    numbers = F.sequence(F.lit(0), F.lit(len(features) - 1))
    inner = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    vary = F.filter(numbers, lambda i: inner & (F.element_at("ranges", i + 1)["lo"] < F.element_at("ranges", i + 1)["hi"]))
    order = F.transform(vary, lambda i: F.struct(draw(F.lit(seed), F.col("tree"), F.col("node"), i, F.lit("order")).alias("o"), i.alias("f")))

    def cut(c: Column) -> Column:
        r = F.element_at("ranges", c["f"] + 1)
        u = draw(F.lit(seed), F.col("tree"), F.col("node"), c["f"], F.lit("cut"))
        return F.struct(c["f"].alias("f"), (r["lo"] + u * (r["hi"] - r["lo"])).alias("cut"))

    nodes = materialise(ranges.select(*key, "n", "pos", F.transform(F.slice(F.array_sort(order), 1, tried), cut).alias("cuts")), "forest-nodes")
    # The table of nodes has a row per tree and node: a bounded side, which Spark measures itself.
    met = placed.join(nodes.where("size(cuts) > 0").select(*key, "cuts"), key)
    below = []
    for j in range(tried):
        c = F.get("cuts", F.lit(j))
        under = F.get("_vec", c["f"]) <= c["cut"]
        below += [F.sum(F.when(under, F.col(x)).otherwise(0.0)).alias(f"{x}{j}") for x in ("w", "p")]
    sums = nodes.join(met.groupBy(*key).agg(*below), key, "left")

    def impurity(n: Column, p: Column) -> Column:
        """Weight times Gini impurity, halved."""
        return F.when(n > 0, p * (n - p) / n).otherwise(0.0)

    options = [F.when(F.size("cuts") > j, F.struct(
        F.round(impurity(F.col(f"w{j}"), F.col(f"p{j}")) + impurity(F.col("n") - F.col(f"w{j}"), F.col("pos") - F.col(f"p{j}")), 9).alias("bad"),
        F.lit(j).alias("j"))) for j in range(tried)]
    best = F.get("cuts", F.array_min(F.array(*options))["j"])
    return sums.select("tree", "node", F.coalesce(best["f"], F.lit(-1)).alias("feature"),
                       F.coalesce(best["cut"], F.lit(0.0)).alias("cut"), "n", "pos").toPandas()
