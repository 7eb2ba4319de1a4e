"""Approximate nearest neighbours by random-projection trees with a measured recall.

Each of several trees halves the points level by level along random directions; the cuts are
medians of a bounded sample, the leaves hold every point. A query visits the leaves of each tree
whose cuts it violates least. How many trees, levels and visits is not guessed: a bounded number
of queries is compared with all points first, and of the plans by which the wanted share of their
true neighbours lies in a visited leaf the one with the least work is taken. Where vectors have no
structure to find, that is one tree of few levels, at last the exact search.

Copies of one vector are reduced to the k+1 smallest ids, so leaves do not fill with them. Leaves
are cut into blocks and their queries into batches of bounded size. A task streams its groups and
keeps the k best per query, so what is shuffled back does not grow with the visits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlwarden.operators import neighbours as exact
from urlwarden.session import materialise


@dataclass(frozen=True)
class Params:
    """sample_rows bounds the rows the cuts are fitted on, audits the queries compared with all
    points; both are drawn by hashes of the id. visit_rows and ship_rows are the work of a visit and
    of a point in one tree more, in compared rows."""

    trees: int = 8
    leaf_rows: int = 256
    sample_rows: int = 32_768
    least_sample: int = 16  # sample rows of a leaf
    audits: int = 256
    recall: float = 0.95
    visit_rows: int = 256
    ship_rows: int = 64
    held: int = 400_000  # candidates a task holds before it reduces them
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    directions: np.ndarray  # levels x dimensions, of unit length
    cuts: list[np.ndarray]  # per level, one for each node

    @property
    def depth(self) -> int:
        return len(self.cuts)

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def upper(self, levels: int) -> Tree:
        return Tree(self.directions[:levels], self.cuts[:levels])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype="int64")
        for direction, cut in zip(self.directions, self.cuts):
            node = 2 * node + (x @ direction > cut[node])
        return node

    def costs(self, x: np.ndarray) -> np.ndarray:
        """Per row and leaf, the squared margins by which the row lies beyond the cuts above it."""
        cost = np.zeros((len(x), 1))
        for direction, cut in zip(self.directions, self.cuts):
            beyond = (x @ direction)[:, None] - cut[None, :]
            left, right = cost + np.maximum(beyond, 0) ** 2, cost + np.maximum(-beyond, 0) ** 2
            cost = np.stack((left, right), axis=2).reshape(len(x), -1)
        return cost


def grow(sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    directions = rng.standard_normal((depth, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    node, cuts = np.zeros(len(sample), dtype="int64"), []
    for level, direction in enumerate(directions):
        value = pd.Series(sample @ direction)
        cut = value.groupby(node).median().reindex(range(1 << level), fill_value=0.0).to_numpy()
        cuts.append(cut)
        node = 2 * node + (value.to_numpy() > cut[node])
    return Tree(directions, cuts)


def cheapest(trees: list[Tree], asked: np.ndarray, near: np.ndarray, n: int, queries: int, p: Params) -> tuple[list[Tree], int]:
    """The trees to use and the leaves to visit in each, by the least work at the wanted recall."""
    plans = []
    for levels in range(trees[0].depth + 1):
        upper = [t.upper(levels) for t in trees]
        need = np.array([probes_needed([t], asked, near) for t in upper])
        used = 1
        while used <= len(trees):
            own = np.sort(need[:used].min(axis=0))
            probes = int(own[max(0, int(np.ceil(p.recall * len(own))) - 1)])
            work = queries * used * probes * (n / (1 << levels) + p.visit_rows) + used * n * p.ship_rows
            plans.append((work, used, levels, probes))
            used *= 2
    _, used, levels, probes = min(plans)
    return [t.upper(levels) for t in trees[:used]], probes


def probes_needed(trees: list[Tree], queries: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each pair of a query and a neighbour, the leaves to visit in every tree to meet it."""
    need = np.full(len(queries), np.iinfo("int64").max)
    for tree in trees:
        for at in range(0, len(queries), 256):
            own = slice(at, at + 256)
            cost, leaf = tree.costs(queries[own]), tree.leaf(near[own])
            mine = cost[np.arange(len(leaf)), leaf][:, None]
            before = (cost < mine) | ((cost == mine) & (np.arange(tree.leaves)[None, :] < leaf[:, None]))
            need[own] = np.minimum(need[own], before.sum(axis=1) + 1)
    return need


def _true_neighbours(points: DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """(id, rank, vec) of the k nearest points of a bounded number of queries, by one pass over all."""
    asked, own = exact._matrix(queries["vec"]), queries["id"].to_numpy()

    def run(batches):
        best = None
        for pdf in batches:
            if not len(pdf):
                continue
            ids = pdf["id"].to_numpy()
            for at in range(0, len(ids), exact.BLOCK_ROWS):
                part = slice(at, at + exact.BLOCK_ROWS)
                vecs = pdf["vec"].to_numpy()[part]
                r, c, d = exact._top_k(exact._squared(asked, np.stack(vecs)), ids[part], own, k)
                found = pd.DataFrame({"id": own[r], "neighbour": ids[part][c], "dist2": d, "vec": vecs[c]})
                best = found if best is None else pd.concat((best, found))
                best = best.sort_values(["id", "dist2", "neighbour"]).groupby("id").head(k)
        if best is not None:
            yield best

    found = points.select("id", "vec").mapInPandas(run, "id long, neighbour long, dist2 double, vec array<double>")
    nearest = Window.partitionBy("id").orderBy("dist2", "neighbour")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("id", "rank", "vec").toPandas()


def _visits(trees: list[Tree], probes: int):
    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                x = exact._matrix(part["vec"])
                for t, tree in enumerate(trees):
                    leaf = np.argsort(tree.costs(x), axis=1, kind="stable")[:, :probes]
                    row = np.repeat(np.arange(len(x)), leaf.shape[1])
                    yield pd.DataFrame({"id": part["id"].to_numpy()[row], "vec": part["vec"].to_numpy()[row],
                                        "tree": np.int32(t), "leaf": leaf.ravel().astype("int32")})
    return run


def _leaves(trees: list[Tree]):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                x = exact._matrix(pdf["vec"])
                yield pdf.assign(leaves=list(np.stack([t.leaf(x) for t in trees], axis=1).astype("int32")))
    return run


def best_of(ids: np.ndarray, others: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest different others of each id, ties by the smaller other."""
    order = np.lexsort((others, dist, ids))
    ids, others, dist = ids[order], others[order], dist[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (others[1:] != others[:-1])
    ids, others, dist = ids[new], others[new], dist[new]
    start = np.ones(len(ids), dtype=bool)
    start[1:] = ids[1:] != ids[:-1]
    at = np.arange(len(ids))
    keep = at - np.maximum.accumulate(np.where(start, at, 0)) < k
    return ids[keep], others[keep], dist[keep]


GROUP = ["tree", "leaf", "block", "batch"]


def _answers(k: int, held: int):
    """Over rows sorted by group, points before queries: the k best of each query in this task."""

    def run(batches):
        key, points, found, n = None, [], [], 0
        for pdf in batches:
            for own, part in pdf.groupby(GROUP, sort=False):
                if own != key:
                    key, points = own, []
                asks = part["asks"].to_numpy()
                if not asks.all():
                    points.append((part["id"].to_numpy()[~asks], exact._matrix(part["vec"][~asks])))
                if not asks.any() or not points:
                    continue
                ids, x = np.concatenate([i for i, _ in points]), np.concatenate([v for _, v in points])
                asked = part["id"].to_numpy()[asks]
                r, c, d = exact._top_k(exact._squared(exact._matrix(part["vec"][asks]), x), ids, asked, k)
                found.append((asked[r], ids[c], d))
                n += len(r)
                if n > held:
                    found = [best_of(*(np.concatenate(x) for x in zip(*found)), k)]
                    n = len(found[0][0])
                    if n > held // 2:
                        yield pd.DataFrame(dict(zip(("id", "neighbour", "dist2"), found[0])))
                        found, n = [], 0
        if found:
            found = best_of(*(np.concatenate(x) for x in zip(*found)), k)
            yield pd.DataFrame(dict(zip(("id", "neighbour", "dist2"), found)))
    return run


def lsh_knn(points: DataFrame, k: int, p: Params = Params()) -> DataFrame:
    """Nearly always the k nearest other points of every query: (id, rank, neighbour, dist2).

    ``points`` has id (bigint, unique), vec (array<double>, all of one length) and optionally
    is_query; further columns are ignored. Distances and ties are those of ``neighbours.knn``.
    Rows with a null id, or a vector that is null or has null or non-finite parts, get no rows and
    are nobody's neighbour. Fewer than k other points give fewer rows, an empty table none.
    """
    if "is_query" not in points.columns:
        points = points.withColumn("is_query", F.lit(True))
    usable = F.size("vec") > 0
    usable &= ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    points = points.where(F.col("id").isNotNull() & usable)
    points = materialise(points.select("id", "vec", F.coalesce("is_query", F.lit(False)).alias("is_query")), "lsh-points")
    first = materialise(exact._first_copies(points, k), "lsh-first")
    n = first.count()
    rng = np.random.default_rng(p.seed)
    drawn = first.orderBy(F.xxhash64("id", F.lit(p.seed)), "id").limit(p.sample_rows).select("vec").toPandas()
    asked = first.where("is_query").orderBy(F.xxhash64("id", F.lit(p.seed + 1)), "id").limit(p.audits).select("id", "vec").toPandas()
    depth, probes, trees = 0, 1, []
    if len(drawn):
        most = max(0, int(np.log2(max(1, len(drawn) // p.least_sample))))
        depth = min(most, max(0, int(np.ceil(np.log2(n / p.leaf_rows)))))
        sample = exact._matrix(drawn["vec"])
        trees = [grow(sample, depth, rng) for _ in range(p.trees)]
    if depth and len(asked):
        true = _true_neighbours(first, asked, k).merge(asked, on="id", suffixes=("", "_asked"))
        queries = first.where("is_query").count()
        trees, probes = cheapest(trees, exact._matrix(true["vec_asked"]), exact._matrix(true["vec"]), n, queries, p)
    if len(trees) and probes >= trees[0].leaves:
        trees, probes = [trees[0].upper(0)], 1  # all leaves of one tree hold all points
    held = first.select("id", "vec").mapInPandas(_leaves(trees), "id long, vec array<double>, leaves array<int>")
    held = held.select("id", "vec", F.posexplode("leaves").alias("tree", "leaf"))
    visits = materialise(first.where("is_query").select("id", "vec").mapInPandas(
        _visits(trees, probes), "id long, vec array<double>, tree int, leaf int"), "lsh-visits")
    at = ["tree", "leaf"]
    room = materialise(
        held.groupBy(at).agg(F.ceil(F.count("*") / exact.BLOCK_ROWS).cast("int").alias("blocks")).join(
            visits.groupBy(at).agg(F.ceil(F.count("*") / exact.QUERY_ROWS).cast("int").alias("batches")), at), "lsh-room")

    def dealt(rows: DataFrame, own: str, other: str, parts: tuple[str, str]) -> DataFrame:
        each = F.pmod(F.xxhash64("id"), F.col(parts[0])).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(parts[1]) - 1))
        return rows.join(room, at).select(*at, each.alias(own), every.alias(other), "id", "vec")

    asking = dealt(visits, "batch", "block", ("batches", "blocks")).withColumn("asks", F.lit(True))
    offered = dealt(held, "block", "batch", ("blocks", "batches")).withColumn("asks", F.lit(False))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = asking.unionByName(offered).repartition(tasks, *GROUP).sortWithinPartitions(*GROUP, "asks")
    found = met.mapInPandas(_answers(k, p.held), "id long, neighbour long, dist2 double")
    nearest = Window.partitionBy("id").orderBy("dist2", "neighbour")
    near = found.distinct().withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return near.unionByName(exact.further_copies(points, first, k)).select("id", "rank", "neighbour", "dist2")
