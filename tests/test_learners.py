"""Extra-trees, the online learner and quantile sketches: properties, quality, and a plain loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlwarden.operators.extra_trees import fit_extra_trees
from urlwarden.operators.metrics import binary_metrics
from urlwarden.operators.online_logit import OnlineConfig, OnlineLogit, fit_online
from urlwarden.operators.quantiles import SKETCH_ERROR, merge_sketches, quantile_sketches
from urlwarden.registry import corpora, queries

ROWS = "id long, a double, b double, c double, y int"


def points(spark, n=3000):
    """Label 1 inside a ring of two of three columns."""
    x = np.random.default_rng(5).normal(size=(n, 3))
    r = np.hypot(x[:, 0], x[:, 1])
    rows = [(i, *map(float, v), int(0.6 < d < 1.5)) for i, (v, d) in enumerate(zip(x, r))]
    return spark.createDataFrame(rows, ROWS)


def area(df):
    return binary_metrics(df, "y", "probability", F.col("probability") >= 0.5).first()["roc_auc"]


def test_extra_trees_learn_a_ring(spark):
    df = points(spark)
    fit, held = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    model = fit_extra_trees(fit, ["a", "b", "c"], "y", trees=15, depth=6)
    assert area(model.score(held)) > 0.9
    nodes = model.nodes
    at = {(r.tree, r.node): r for r in nodes.itertuples()}
    for r in nodes.itertuples():  # children share out the rows of their parent
        if r.feature >= 0:
            left, right = at[r.tree, 2 * r.node], at[r.tree, 2 * r.node + 1]
            assert (left.n + right.n, left.pos + right.pos) == (r.n, r.pos) and left.n and right.n
    assert set(nodes.tree) == set(range(15)) and nodes.node.max() < 128
    again = fit_extra_trees(fit.repartition(7), ["a", "b", "c"], "y", trees=15, depth=6).nodes
    order = ["tree", "node"]
    assert nodes.sort_values(order).reset_index(drop=True).equals(again.sort_values(order).reset_index(drop=True))


def test_extra_trees_odd_rows(spark):
    rows = [(1, None, 1.0, 0.0, 1)] * 3 + [(2, 2.0, 1.0, 0.0, 0), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, ROWS)
    got = fit_extra_trees(df, ["a", "b", "c"], "y", trees=3, depth=2, tried=3).score(df).collect()
    assert {r["id"]: r["probability"] for r in got} == {1: 1.0, 2: 0.0, 3: 0.0}
    one = fit_extra_trees(df.where("id = 1"), ["a", "b", "c"], "y", trees=2, depth=3)
    assert one.nodes["feature"].tolist() == [-1, -1] and one.score(df).first()["probability"] == 1.0
    none = fit_extra_trees(df.limit(0), ["a", "b", "c"], "y", trees=2, depth=3)
    assert not len(none.nodes) and none.score(df).first()["probability"] is None


def plain(shards, cfg):
    """Rows one by one: steps of cfg.batch rows by the mean gradient, shards averaged by rows."""
    w, bias, t = np.zeros(cfg.buckets), 0.0, 1
    t0 = 1 / (math.sqrt(1 / math.sqrt(cfg.alpha)) * cfg.alpha)
    for _ in range(cfg.epochs):
        ends = []
        for rows in shards:
            v, b, s = w.copy(), bias, t
            for i in range(0, len(rows), cfg.batch):
                part = rows[i : i + cfg.batch]
                eta, whole = 1 / (cfg.alpha * (t0 + s)), sum(r[2] for r in part)
                step, shift = np.zeros(cfg.buckets), 0.0
                for x, y, c in part:
                    g = eta * c / whole * (1 / (1 + math.exp(-(v @ x + b))) - y)
                    step, shift = step + g * x, shift + g
                v, b, s = v * (1 - eta * cfg.alpha) - step, b - shift, s + 1
            ends.append((v, b, len(rows)))
        n = sum(k for *_, k in ends)
        w, bias = sum(v * k for v, _, k in ends) / n, sum(b * k for _, b, k in ends) / n
        t += -(-n // (cfg.shards * cfg.batch))
    return w, bias


def test_online_logit_as_a_plain_loop(spark):
    cfg = OnlineConfig(buckets=64, epochs=4, batch=4, shards=3)
    rng = np.random.default_rng(2)
    rows = [(i, [f"t{k}" for k in rng.integers(0, 30, rng.integers(0, 6))], int(rng.integers(0, 2)), float(rng.integers(1, 4))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, terms array<string>, y int, w double")
    told = df.selectExpr("id", "terms", "y", "w", "pmod(xxhash64(id), 3) AS shard", "xxhash64(42, id) AS o",
                         "transform(terms, t -> pmod(xxhash64(t), 64)) AS x").orderBy("o").collect()
    shards = []
    for k in range(3):
        mine = []
        for r in told:
            if r["shard"] == k:
                x = np.bincount(np.array(r["x"], dtype=int), minlength=64).astype(float)
                mine.append((x / (np.linalg.norm(x) or 1), r["y"], r["w"]))
        shards.append(mine)
    w, bias = plain(shards, cfg)
    got = fit_online(df, "id", "terms", "y", "w", cfg)
    assert got.weights == pytest.approx(w, abs=1e-9) and got.bias == pytest.approx(bias, abs=1e-9)


def test_online_logit_learns_and_takes_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [f"{'pq'[y]}{k}" if rng.random() < 0.4 else f"c{k}" for k in rng.integers(0, 20, 8)], y)
            for i in range(1500) for y in [i % 2]]
    df = spark.createDataFrame(rows, "id long, terms array<string>, y int")
    model = fit_online(df.where("id % 3 > 0"), "id", "terms", "y", cfg=OnlineConfig(buckets=4096, epochs=5, shards=4))
    assert area(model.score(df.where("id % 3 = 0"), "terms")) > 0.95
    odd = spark.createDataFrame([(1, None), (2, [])], "id long, terms array<string>")
    for r in model.score(odd, "terms").collect():
        assert r["probability"] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    none = fit_online(df.limit(0), "id", "terms", "y", cfg=OnlineConfig(buckets=16, epochs=2, shards=2))
    assert isinstance(none, OnlineLogit) and not none.weights.any()
    hot = fit_online(df.withColumn("id", F.lit(7)), "id", "terms", "y", cfg=OnlineConfig(buckets=64, epochs=1, shards=4))
    assert hot.weights.any()  # all rows of one id are one shard, streamed batch by batch


@pytest.mark.parametrize("key", ["online_logit", "extra_trees"])
def test_scores_of_scans_tell_labels(spark, sf_dir, key):
    """Area under the curve over the scan requests the learners were fitted on."""
    labels = corpora.scan_requests(spark, sf_dir).select("scan_id", F.col("label").cast("int").alias("y"))
    scored = queries.queries()[key](spark, sf_dir).join(labels, "scan_id")
    assert scored.count() == labels.count() and area(scored) > 0.9


def test_sketches_of_parts_hold_their_ranks(spark):
    """40,000 values in uneven groups with a frequent one, nulls and an empty group, merged."""
    df = spark.range(40_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE string(id % 5) END AS part", "id",
                                        "CASE WHEN id % 4 = 0 THEN 7.0 WHEN id % 11 = 0 THEN NULL ELSE (id * 7919) % 40000 END AS x",
                                        "CAST(NULL AS DOUBLE) AS y")
    sketches = quantile_sketches(df, ["x", "y"], ["part"])
    got = merge_sketches(sketches, [], [0.0, 0.1, 0.5, 0.9, 1.0]).collect()
    xs = np.sort([r["x"] for r in df.where("x IS NOT NULL").select("x").collect()])
    assert {r["column"] for r in got} == {"x"} and {r["n"] for r in got} == {len(xs)} and len(got) == 5
    for r in got:
        below, upto = np.searchsorted(xs, r["value"], "left"), np.searchsorted(xs, r["value"], "right")
        assert below - SKETCH_ERROR * len(xs) - 1 <= r["prob"] * len(xs) <= upto + SKETCH_ERROR * len(xs) + 1
    assert merge_sketches(quantile_sketches(df.limit(0), ["x"], ["part"]), ["part"], [0.5]).count() == 0
