"""Neighbours by random-projection trees against a plain search."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlwarden.operators import neighbours, resample
from urlwarden.operators.approx_neighbours import Params, best_of, cheapest, grow, lsh_knn, probes_needed

SMALL = Params(leaf_rows=32, audits=64)
SCHEMA = "id bigint, vec array<double>, is_query boolean"


def table(spark, x, asks=lambda i: True, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row], asks(int(i))) for i, row in zip(ids, x)], SCHEMA)


def plain(x, k, asked):
    """The ids of the k nearest other rows, ties by id."""
    out = {}
    for i in asked:
        d = np.round(((x - x[i]) ** 2).sum(axis=1), neighbours.DIGITS)
        d[i] = np.inf
        out[i] = list(np.lexsort((np.arange(len(x)), d))[:k])
    return out


def told(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["id"], r["rank"])):
        out.setdefault(r["id"], []).append(r["neighbour"])
    return out


def vectors(kind, n=4000, dim=64):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, dim))
    if kind == "crowds":  # a third of all rows lie close together
        x = rng.normal(size=(60, dim))[rng.integers(0, 60, n)] + 0.3 * x
        x[::3] = x[0] + 0.01 * rng.normal(size=(len(x[::3]), dim))
    return x


@pytest.mark.parametrize("kind", ["crowds", "even"])
def test_recall(spark, kind):
    """The share of true neighbours found is at least 0.9, also where vectors have no structure."""
    x = vectors(kind)
    found = told(lsh_knn(table(spark, x, lambda i: i % 20 == 0), 5, SMALL))
    want = plain(x, 5, range(0, len(x), 20))
    assert set(found) == set(want)
    assert all(len(f) == 5 for f in found.values())
    assert np.mean([len(set(found[i]) & set(want[i])) / 5 for i in want]) >= 0.9


def test_distances_are_exact_and_rows_repeat(spark):
    x = vectors("crowds", 1000, 8)
    points = table(spark, x)
    rows = lsh_knn(points, 3, SMALL).collect()
    assert sorted(rows) == sorted(lsh_knn(points.repartition(7), 3, SMALL).collect())
    for r in rows:
        assert r["dist2"] == pytest.approx(((x[r["id"]] - x[r["neighbour"]]) ** 2).sum(), abs=1e-8)
        assert r["id"] != r["neighbour"]


def test_small_blocks_and_copies(spark, monkeypatch):
    """A third of the rows are copies of one vector, and blocks and batches are tiny."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 10)
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(600, 3)), 1)
    x[::3] = 0.5
    found, want = told(lsh_knn(table(spark, x), 4, SMALL)), plain(x, 4, range(600))
    assert all(found[i] == want[i] for i in range(0, 600, 3))  # copies: the smallest other ids
    assert np.mean([len(set(found[i]) & set(want[i])) / 4 for i in want]) >= 0.9


def test_few_rows_are_searched_exactly(spark):
    x = vectors("even", 60, 4)
    assert told(lsh_knn(table(spark, x), 5)) == plain(x, 5, range(60))


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0], True), (2, [1.0, 0.0], None), (3, None, True), (4, [nan, 1.0], True), (5, [inf, 0.0], True),
            (6, [None, 1.0], True), (None, [0.0, 0.0], True), (7, [], True), (8, [0.0, 3.0], False)]
    points = spark.createDataFrame(rows, SCHEMA).withColumn("dist2", F.lit("clash")).withColumn("rank", F.lit(0))
    found = lsh_knn(points, 5)
    assert found.columns == ["id", "rank", "neighbour", "dist2"]
    assert told(found) == {1: [2, 8]}
    assert lsh_knn(points.limit(0), 5).collect() == []


def test_visits_needed():
    """A point is in its own leaf at the first visit, and all leaves are enough for any."""
    x = vectors("even", 500, 6)
    trees = [grow(x, 4, np.random.default_rng(s)) for s in range(3)]
    assert (probes_needed(trees, x, x) == 1).all()
    assert probes_needed(trees, x, x[::-1]).max() <= 16
    assert all(np.bincount(t.leaf(x), minlength=16).min() > 0 for t in trees)


def test_resampling_with_trees(spark):
    x = np.random.default_rng(3).normal(size=(200, 2))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], int(i < 30)) for i in range(200)],
                               "id bigint, vec array<double>, label int")
    counts = {r["label"]: r["n"] for r in resample.class_counts(resample.smote(df, search=lsh_knn)).collect()}
    assert counts == {0: 170, 1: 170}
    near, far = (sorted(map(str, resample.smote(df, search=s).collect())) for s in (lsh_knn, neighbours.knn))
    assert near == far  # so few rows are one leaf


def test_best_of_candidates():
    """Repeated candidates count once, ties go to the smaller other."""
    ids, others = np.array([2, 1, 1, 1, 2, 1]), np.array([9, 7, 5, 7, 8, 6])
    got = best_of(ids, others, np.array([0.5, 1.0, 1.0, 1.0, 0.5, 2.0]), 2)
    assert [x.tolist() for x in got] == [[1, 1, 2, 2], [5, 7, 8, 9], [1.0, 1.0, 0.5, 0.5]]


def test_tasks_that_reduce_often(spark):
    x = vectors("crowds", 1000, 8)
    points = table(spark, x)
    assert sorted(lsh_knn(points, 3, SMALL).collect()) == sorted(lsh_knn(points, 3, replace(SMALL, held=50)).collect())


def test_the_plan_follows_the_data():
    """Structure is used where there is some; without it the work is no more than the exact search's."""
    rng = np.random.default_rng(1)
    for kind, share in (("crowds", 0.5), ("even", 1.0)):
        x = vectors(kind)
        trees = [grow(x, 5, rng) for _ in range(8)]
        asked = rng.choice(len(x), 50, replace=False)
        near = [j for js in plain(x, 5, asked).values() for j in js]
        used, probes = cheapest(trees, np.repeat(x[asked], 5, axis=0), x[near], 10**9, 10**8, Params())
        assert len(used) * probes / used[0].leaves <= share
