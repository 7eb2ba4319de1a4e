"""Exact nearest neighbours as a distributed join over pivot cells, and Tomek links.

Points go to the cell of their nearest pivot. A query first gets an upper bound of its k-th
distance from its own cell, then visits only cells the triangle inequality cannot rule out
and keeps k candidates per visited block. Copies of one vector are reduced to the k+1
smallest ids first: no more of them can be among anybody's k nearest. So a group of copies
never meets itself pair by pair. Cells that lie together form tiles of bounded size, a cell that is
too large for one is cut into blocks, and the queries of a tile go in batches of bounded size, so no
task holds an unbounded group. A vector leaves once per tile it has to see, not once per cell: where
pruning is weak, what is shuffled grows with the number of tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlwarden.session import materialise

MAX_PIVOTS = 1024
BLOCK_ROWS = 2048
QUERY_ROWS = 8192
TILE_VALUES = 1 << 21  # values of the vectors of a tile, or of a batch of its queries
COPY_SALTS = 64
SLACK = 1e-6
DIGITS = 9
# Values of the matrices and frames that one step of a task holds.
HELD = 1 << 20


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype("float64")


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, row by row of ``a`` so that the difference array stays small."""
    out = np.empty((len(a), len(b)))
    for i in range(len(a)):
        d = b - a[i]
        out[i] = (d * d).sum(axis=1)
    return out


def _top_k(dist: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """Row and column positions of the k nearest per row, ties by id, never the row itself."""
    dist = np.where(ids[None, :] == own[:, None], np.inf, np.round(dist, DIGITS))
    order = np.lexsort((np.broadcast_to(ids, dist.shape), dist), axis=1)[:, :k]
    rows = np.repeat(np.arange(len(dist)), order.shape[1])
    cols = order.ravel()
    keep = np.isfinite(dist[rows, cols])
    return rows[keep], cols[keep], dist[rows[keep], cols[keep]]


def _nearest(asked: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """The result of ``_top_k`` over ``_squared``, in slices of rows. Products of matrices tell which
    points can be among the k nearest, and only their distances are computed term by term."""
    if not len(x):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    with np.errstate(over="ignore", invalid="ignore"):
        norm_x, norm_a = (x * x).sum(axis=1), (asked * asked).sum(axis=1)
    top = norm_x.max()
    step = max(1, HELD // len(x))
    for lo in range(0, len(asked), step):
        a, mine = asked[lo:lo + step], own[lo:lo + step]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = norm_a[lo:lo + step, None] + norm_x[None, :] - 2.0 * (a @ x.T)
        if not np.isfinite(rough).all():  # beyond the range of the products
            r, c, d = _top_k(_squared(a, x), ids, mine, k)
            found.append((r + lo, c, d))
            continue
        rough[ids[None, :] == mine[:, None]] = np.inf
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(a), np.inf)
        # Twice the error of the products, and of the rounding.
        limit = limit + 1e-11 * (norm_a[lo:lo + step] + top) + 2 * 10.0 ** -DIGITS
        r, c = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
        d, part = np.empty(len(r)), max(1, HELD // x.shape[1])
        for i in range(0, len(r), part):
            gap = x[c[i:i + part]] - a[r[i:i + part]]
            d[i:i + part] = (gap * gap).sum(axis=1)
        d = np.round(d, DIGITS)
        order = np.lexsort((ids[c], d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < k
        found.append((r[first] + lo, c[first], d[first]))
    return tuple(np.concatenate(part) for part in zip(*found))


def _first_copies(points: DataFrame, k: int) -> DataFrame:
    """Add ``copy``: the place among the k+1 smallest ids of equal vectors, null beyond them."""
    salted = points.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)))
    inner = Window.partitionBy("vec", "_salt").orderBy("id")
    outer = Window.partitionBy("vec").orderBy("id")
    first = salted.withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= k + 1)
    return first.withColumn("copy", F.row_number().over(outer)).where(
        F.col("copy") <= k + 1).drop("_salt", "_rn")


def _assign(pivots: np.ndarray):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                d = _squared(_matrix(pdf["vec"]), pivots)
                cell = d.argmin(axis=1)
                yield pdf.assign(cell=cell.astype("int32"), radius=np.sqrt(d[np.arange(len(d)), cell]))
    return run


def _bound(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(pdf["vec"]), pdf["id"].to_numpy()
        asks = pdf["is_query"].to_numpy()
        bound = np.full(len(pdf), np.inf)
        if len(pdf) > k and asks.any():
            d = _squared(x[asks], x)
            d[np.arange(asks.sum()), np.flatnonzero(asks)] = np.inf
            bound[asks] = np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1])
        return pdf.assign(bound=bound)
    return run


def _groups(pivots: np.ndarray, sizes: np.ndarray, rows: int) -> np.ndarray:
    """The group of each cell: halves by the widest axis until a group has few rows or one cell."""
    group, todo, n = np.zeros(len(pivots), int), [np.arange(len(pivots))], 0
    while todo:
        part = todo.pop()
        if len(part) == 1 or sizes[part].sum() <= rows:
            group[part], n = n, n + 1
            continue
        order = part[np.argsort(pivots[part, np.ptp(pivots[part], axis=0).argmax()], kind="stable")]
        upto = np.cumsum(sizes[order])
        cut = min(max(1, int(np.searchsorted(upto, upto[-1] / 2))), len(order) - 1)
        todo += [order[:cut], order[cut:]]
    return group


def _reach(x: np.ndarray, bound: np.ndarray, own: np.ndarray, pivots: np.ndarray, radii: np.ndarray,
           cells: np.ndarray) -> np.ndarray:
    """Which of the cells the triangle inequality cannot rule out for a query, by the bound of its k-th distance."""
    to_pivot = np.sqrt(_squared(x, pivots[cells]))
    d_own = np.sqrt(((x - pivots[own]) ** 2).sum(axis=1))[:, None]
    at, of = np.unique(own, return_inverse=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (to_pivot ** 2 - d_own ** 2) / (2 * np.sqrt(_squared(pivots[at], pivots[cells]))[of])
    plane = np.where(cells[None, :] == own[:, None], 0.0, np.nan_to_num(plane, nan=0.0, posinf=0.0))
    return np.maximum(plane, to_pivot - radii[None, cells]) <= bound[:, None] + SLACK


def _visits(pivots: np.ndarray, radii: np.ndarray, blocks: np.ndarray, groups: np.ndarray | None = None):
    """For each query the blocks of all groups with a cell within reach of its bound; without ``groups`` each cell is one."""
    groups = np.arange(len(pivots)) if groups is None else groups
    cells = np.argsort(groups, kind="stable")
    starts = np.searchsorted(groups[cells], np.arange(len(blocks)))

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, bound, own = _matrix(pdf["vec"]), pdf["bound"].to_numpy(), pdf["cell"].to_numpy()
            reach = np.logical_or.reduceat(_reach(x, bound, own, pivots, radii, cells), starts, axis=1)
            q, c = np.nonzero(reach & (blocks[None, :] > 0))
            # A query meets many blocks: its vector leaves as often, a bounded frame at a time.
            step = max(1, HELD // max(1, x.shape[1]))
            upto = np.cumsum(blocks[c])
            total = int(upto[-1]) if len(upto) else 0
            ids, vecs = pdf["id"].to_numpy(), pdf["vec"].to_numpy()
            for lo in range(0, total, step):
                row = np.arange(lo, min(total, lo + step))
                at = np.searchsorted(upto, row, side="right")
                block = row - upto[at] + blocks[c[at]]
                yield pd.DataFrame({"id": ids[q[at]], "vec": vecs[q[at]], "cell": c[at].astype("int32"),
                                    "block": block.astype("int32"), "own": own[q[at]], "bound": bound[q[at]]})
    return run


def _search(k: int, pivots: np.ndarray, radii: np.ndarray):
    """The k nearest per query among the points of a tile, cell by cell within reach."""
    def run(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({"id": [], "neighbour": [], "dist2": []})
        own, ids = queries["id"].to_numpy(), points["id"].to_numpy()
        asked, x, cell = _matrix(queries["vec"]), _matrix(points["vec"]), points["cell"].to_numpy()
        cells, order = np.unique(cell), np.argsort(cell, kind="stable")
        ends = np.searchsorted(cell[order], cells, side="right")
        best, near = np.full((len(own), k), np.inf), np.zeros((len(own), k), ids.dtype)
        step = max(1, HELD // len(cells))
        for lo in range(0, len(own), step):
            part = slice(lo, lo + step)
            reach = _reach(asked[part], queries["bound"].to_numpy()[part], queries["own"].to_numpy()[part], pivots, radii, cells)
            for i, end in enumerate(ends):
                rows, at = lo + np.flatnonzero(reach[:, i]), order[ends[i - 1] if i else 0:end]
                r, c, d = _nearest(asked[rows], own[rows], x[at], ids[at], k)
                place = np.arange(len(r)) - np.searchsorted(r, r)
                dist, other = np.full((len(rows), 2 * k), np.inf), np.zeros((len(rows), 2 * k), ids.dtype)
                dist[:, :k], other[:, :k] = best[rows], near[rows]
                dist[r, k + place], other[r, k + place] = d, ids[at][c]
                first = np.lexsort((other, dist), axis=1)[:, :k]
                best[rows], near[rows] = np.take_along_axis(dist, first, 1), np.take_along_axis(other, first, 1)
        r, c = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"id": own[r], "neighbour": near[r, c], "dist2": best[r, c]})
    return run


def further_copies(points: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Neighbours of queries beyond the first copies: the first copies of their vector, at distance 0."""
    others = points.where("is_query").join(first.select("id"), "id", "left_anti")
    copies = first.select("vec", F.col("id").alias("neighbour"), F.col("copy").alias("rank"))
    return others.join(copies.where(F.col("rank") <= k), "vec").select(
        "id", "neighbour", F.lit(0.0).alias("dist2"), "rank")


def knn(points: DataFrame, k: int) -> DataFrame:
    """The k nearest other points of every query: (id, rank, neighbour, dist2).

    ``points`` has id (bigint), vec (array<double>) and optionally is_query. Squared
    distances are rounded to 9 digits; ties go to the smaller id.
    """
    if "is_query" not in points.columns:
        points = points.withColumn("is_query", F.lit(True))
    points = materialise(points.select("id", "vec", "is_query"), "knn-points")
    first = _first_copies(points, k)
    first = materialise(first, "knn-first")
    n = first.count()
    n_pivots = int(min(MAX_PIVOTS, max(1, np.sqrt(n) / 2)))
    sample = first.where(F.col("copy") == 1).orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()
    pivots = np.array([r["vec"] for r in sample], dtype="float64")
    assigned = first.mapInPandas(
        _assign(pivots), "id long, vec array<double>, is_query boolean, copy int, cell int, radius double")
    assigned = materialise(assigned, "knn-cells")
    # One row per pivot: how large a cell is and how far it reaches.
    stats = assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("r")).collect()
    radii, sizes = np.zeros(len(pivots)), np.zeros(len(pivots), dtype="int64")
    for row in stats:
        radii[row["cell"]], sizes[row["cell"]] = row["r"], row["n"]
    per_cell = F.array(*[F.lit(int(max(1, -(-b // BLOCK_ROWS)))) for b in sizes])
    assigned = assigned.withColumn("block", F.pmod(
        F.xxhash64("id"), F.element_at(per_cell, F.col("cell") + 1)).cast("int"))
    bounded = assigned.groupBy("cell", "block").applyInPandas(
        _bound(k), "id long, vec array<double>, is_query boolean, copy int, cell int, radius double, "
                   "block int, bound double")
    asks = materialise(bounded.where("is_query").select("id", "vec", "cell", "bound"), "knn-bounds")
    # Tiles as large as a task may hold, but some for each core.
    cores = points.sparkSession.sparkContext.defaultParallelism
    most = max(BLOCK_ROWS, TILE_VALUES // max(1, pivots.shape[-1]))
    rows = max(1, min(most, n // (2 * cores)))
    groups = _groups(pivots, sizes, rows)
    tiles = -(-np.bincount(groups, sizes).astype("int64") // most)
    visits = asks.mapInPandas(_visits(pivots, radii, tiles, groups),
                              "id long, vec array<double>, cell int, block int, own int, bound double")
    # Tables of one row per tile.
    counts = visits.groupBy("cell", "block").count().collect()
    batches = {(r["cell"], r["block"]): -(-r["count"] // max(QUERY_ROWS, most)) for r in counts}
    first_tile = np.cumsum(tiles) - tiles
    parts = np.zeros(max(1, int(tiles.sum())), int)
    for (group, block), some in batches.items():
        parts[first_tile[group] + block] = some
    of = lambda values, at: F.element_at(F.lit([int(v) for v in values]), at + 1)
    in_parts = of(parts, of(first_tile, F.col("group")) + F.col("block"))
    asked = visits.withColumnRenamed("cell", "group").withColumn("batch", F.pmod(F.xxhash64("id"), in_parts).cast("int"))
    offered = assigned.select("id", "vec", "cell", of(groups, F.col("cell")).alias("group")).withColumn(
        "block", F.pmod(F.xxhash64("id"), of(np.maximum(tiles, 1), F.col("group"))).cast("int"))
    offered = offered.where(in_parts > 0).withColumn("batch", F.explode(F.sequence(F.lit(0), in_parts - 1)))
    found = asked.groupBy("group", "block", "batch").cogroup(
        offered.groupBy("group", "block", "batch")).applyInPandas(
        _search(k, pivots, radii), "id long, neighbour long, dist2 double")
    nearest = Window.partitionBy("id").orderBy("dist2", "neighbour")
    near = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return near.unionByName(further_copies(points, first, k)).select("id", "rank", "neighbour", "dist2")


def tomek_links(points: DataFrame) -> DataFrame:
    """Pairs of mutual nearest neighbours with different labels: (id, other), id < other."""
    points = materialise(points.select("id", "vec", "label"), "tomek-points")
    near = materialise(knn(points, 1), "tomek-near").select("id", F.col("neighbour").alias("other"))
    back = near.select(F.col("other").alias("id"), F.col("id").alias("other"))
    mutual = near.join(back, ["id", "other"], "left_semi").where(F.col("id") < F.col("other"))
    labels = points.select(F.col("id"), "label")
    pairs = mutual.join(labels, "id").join(
        labels.select(F.col("id").alias("other"), F.col("label").alias("other_label")), "other")
    return pairs.where(F.col("label") != F.col("other_label")).select("id", "other")
