"""Steps that must stay bounded or cheap on large tables, on rows made here."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from urlwarden.operators import neighbours, ngrams
from urlwarden.plans import prepare
from urlwarden.plans import scan as scan_plan
from urlwarden.registry import corpora as C
from urlwarden.session import materialise, workspace


@pytest.mark.parametrize("digits", [0, 8])
def test_nearest_in_slices_is_the_plain_result(monkeypatch, digits):
    monkeypatch.setattr(neighbours, "HELD", 500)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(90, 6)), digits)
    ids, k = rng.permutation(90), 4
    want = neighbours._top_k(neighbours._squared(x[:40], x), ids, ids[:40], k)
    got = neighbours._nearest(x[:40], ids[:40], x, ids, k)
    assert all((g == w).all() for g, w in zip(got, want))
    big = x * 1e170
    want = neighbours._top_k(neighbours._squared(big[:5], big), ids, ids[:5], k)
    assert all((g == w).all() for g, w in zip(neighbours._nearest(big[:5], ids[:5], big, ids, k), want))


def test_visits_leave_in_bounded_frames(monkeypatch):
    rng = np.random.default_rng(2)
    pivots, n = rng.normal(size=(50, 8)), 400
    blocks = np.arange(50) % 3
    pdf = pd.DataFrame({"id": np.arange(n), "vec": list(rng.normal(size=(n, 8))), "cell": np.zeros(n, int), "bound": np.full(n, 100.0)})
    monkeypatch.setattr(neighbours, "HELD", 8 * 64, raising=False)
    frames = list(neighbours._visits(pivots, np.full(50, 1.0), blocks)([pdf]))
    assert max(map(len, frames)) <= 64
    rows = pd.concat(frames)
    want = {(i, c, b) for i in range(n) for c in range(50) for b in range(blocks[c])}
    assert len(rows) == len(want) and set(zip(rows["id"], rows["cell"], rows["block"])) == want
    assert all((v == pdf["vec"][i]).all() for i, v in zip(rows["id"], rows["vec"]))


def test_vectors_leave_once_per_tile(spark, monkeypatch):
    """No table on disk has more rows than there are points; tiles, blocks of one cell and batches give the plain result."""
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate([rng.normal(size=(500, 3)), rng.normal(size=(300, 3)) * 0.01]), 3)
    rows = [(int(i), [float(v) for v in x[i]], bool(i % 3)) for i in range(len(x))]
    points = spark.createDataFrame(rows, "id bigint, vec array<double>, is_query boolean").repartition(5)
    ids = np.arange(len(x))
    r, c, d = neighbours._top_k(neighbours._squared(x, x), ids, ids, 4)
    want = sorted((int(i), int(j), round(float(v), 9)) for i, j, v in zip(r, c, d) if i % 3)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 50)
    for values in (1, 1 << 10):
        monkeypatch.setattr(neighbours, "TILE_VALUES", values, raising=False)
        made = []
        monkeypatch.setattr(neighbours, "materialise", lambda df, name: made.append(materialise(df, name)) or made[-1])
        got = neighbours.knn(points, 4).collect()
        assert sorted((r["id"], r["neighbour"], r["dist2"]) for r in got) == want
        assert max(df.count() for df in made) <= len(x)
    pivots, sizes = rng.normal(size=(50, 3)), np.full(50, 10)
    groups = neighbours._groups(pivots, sizes, 100)
    assert np.bincount(groups, sizes).max() <= 100 and len(np.unique(groups)) < 15
    pdf = pd.DataFrame({"id": np.arange(20), "vec": list(rng.normal(size=(20, 3))), "cell": np.zeros(20, int), "bound": np.full(20, 100.0)})
    rows = pd.concat(neighbours._visits(pivots, np.ones(50), np.bincount(groups).clip(max=1), groups)([pdf]))
    assert len(rows) == 20 * (groups.max() + 1) and not rows.duplicated(["id", "cell"]).any()


def test_char_grams_are_counted_in_batches(spark, monkeypatch):
    texts = ["http://Aa.bb/  x", "ab", "abc", "\u0130\u00e4\U0001f600\U0001f600z\u20ac", "abc\x00\x00\x00", None, "", *["same-text"] * 9]
    df = spark.createDataFrame([(k, t) for t in texts for k in ("a", "b", None)], "corpus string, url string").repartition(3)
    whole = ngrams.char_grams_stage().transform(df).selectExpr("corpus", "explode(char_grams) as term").groupBy("corpus", "term").count()
    got = ngrams.char_gram_counts(df, ["corpus"])
    assert got.dtypes[-1] == ("tf", "bigint")
    assert sorted(map(str, got.collect())) == sorted(str(r).replace("count=", "tf=") for r in whole.collect())
    # One window of a batch is one row, however often it occurs.
    (terms, counts), *_ = ngrams.window_counts(["same-text"] * 9, 3, 5)
    assert terms.to_pylist().count("sam") == 1 and set(counts) == {9}


def test_word_grams_leave_packed(spark, monkeypatch):
    texts = ["http://Aa.bb/  x", "one two one two one", "one", "", "a b", "\u0130st\u00e4 \U0001f600 z\u20ac_9 one two", *["same text"] * 9]
    df = spark.createDataFrame([(k, t) for t in texts for k in ("a", "b", None)], "corpus string, url string").repartition(3)
    plain = ngrams.transform_all(df, ngrams.word_grams_stages()).selectExpr("corpus", "explode(word_grams) as term").groupBy("corpus", "term").count()
    want = sorted((str(r["corpus"]), r["term"], r["count"]) for r in plain.collect())
    for held, buckets in ((1 << 20, None), (1, 7), (4, 1000)):
        monkeypatch.setitem(ngrams.__dict__, "HELD", held)
        got = ngrams.word_gram_counts(df, ["corpus"], buckets=buckets)
        assert got.dtypes[-1] == ("tf", "bigint")
        assert sorted((str(r["corpus"]), r["term"], r["tf"]) for r in got.collect()) == want
    parts = ["con", "ver", "in", "re", "ta", "du", "ring", "mo", "lo"]
    line = ["".join(parts[j] for j in row) for row in np.random.default_rng(5).integers(0, 9, (20000, 3))]
    packed = list(ngrams._word_counts(pa.array(line), np.array([20000]), 3, 4))
    rows = sum(n for _, n, _, _ in packed)
    assert rows > 35000 and sum(len(p) for *_, p in packed) < 10 * rows
    # One n-gram is in one bucket, whatever else a task holds.
    at = lambda texts: {t: b for b, n, size, p in ngrams._word_counts(pa.array(texts), np.array([len(texts)]), 3, 50) for t in ngrams._unpacked(n, size, p)["term"].to_pylist()}
    one, two = at(["aa", "bb", "cc"]), at(["zz", "aa", "bb", "cc", "aa"])
    assert {t: two[t] for t in one} == one


def test_entries_of_vectors_hold_no_zeros(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "")], "id int, url string")
    made = ngrams.fit_char_tfidf(df).transform(df)
    sizes = {r["id"]: len(r["e"]) for r in made.select("id", ngrams.entries("char_tfidf").alias("e")).collect()}
    assert sizes == {1: 3, 2: 0}


def test_weights_are_those_of_the_vectors(spark):
    """Rows made by batches, without windows or vectors, are the entries of the model's vectors."""
    texts = ["http://Aa.bb/  x", "abab", "ab", None, "", "\u0130\u00e4\U0001f600\U0001f600z\u20ac", "same-text same-text", "x.y\uffff/q"]
    df = spark.createDataFrame([(k, i, t) for i, t in enumerate(texts) for k in ("a", None)], "corpus string, url_id int, url string").repartition(3)
    for size in (40, 1200):
        model = ngrams.fit_char_tfidf(df, size=size)
        terms = model.stages[1].vocabulary
        made = model.transform(df.where("url is not null")).select("corpus", "url_id", ngrams.entries("char_tfidf").alias("e"))
        want = {(str(r["corpus"]), r["url_id"], terms[e["indices"]]): e["values"] for r in made.collect() for e in r["e"]}
        got = {(str(r["corpus"]), r["url_id"], r["term"]): r["weight"] for r in ngrams.char_tfidf_rows(model, df, ["corpus", "url_id"]).collect()}
        assert got == pytest.approx(want, abs=1e-12) and len(want) > 40
        whole = model.stages[0].transform(df.where("url is not null")).selectExpr("explode(array_distinct(char_grams)) as term")
        counts = {r["term"]: r["count"] for r in whole.groupBy("term").count().collect()}
        assert {r["term"]: r["df"] for r in ngrams.char_document_counts(df, terms).collect()} == {t: counts[t] for t in terms}
    plan = ngrams.char_tfidf_rows(model, df, ["corpus", "url_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "UDF" not in plan


def test_reasons_are_told_behind_the_dealing(spark):
    rows = spark.createDataFrame([("http://a.b/x",), ("http://[x/",), (None,), ("http://a\uff0fb/",)], "url string").repartition(3)
    accepted, rejects = scan_plan.split_requests(rows)
    plan = accepted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Repartition")
    assert "regexp_extract" not in plan[plan.index("Repartition"):]
    assert [r["url"] for r in accepted.collect()] == ["http://a.b/x"]
    assert sorted(r["reason"] for r in rejects.collect()) == [
        "blank url", "delimiter in another form in host", "unbalanced brackets in host"]


def test_tables_are_spread_by_their_size(spark, monkeypatch):
    path = workspace(spark, "spread")
    spark.range(20000).coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    monkeypatch.setattr(C, "PART_BYTES", 1000, raising=False)
    wide = C.spread(table)
    assert wide.rdd.getNumPartitions() > 40 and wide.count() == 20000
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_rows_of_one_row_group_are_dealt(spark, monkeypatch):
    """More splits than tasks are wanted, but one of them reads all rows."""
    path = workspace(spark, "one-group")
    spark.range(200000).coalesce(1).write.parquet(path)
    monkeypatch.setitem(C.__dict__, "PART_BYTES", 1 << 20)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        table = spark.read.parquet(path)
        assert table.rdd.getNumPartitions() >= 8
        sizes = C.spread(table).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sum(sizes) == 200000 and max(sizes) < 2 * 200000 / 8
    assert len(sizes) % spark.sparkContext.defaultParallelism == 0


def test_power_grids_run_on_all_cores(spark, monkeypatch):
    seen = {}

    def kept(df, name, *more):
        made = materialise(df, name, *more)
        seen[name] = made
        return made

    monkeypatch.setattr(prepare, "materialise", kept)
    x = F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0
    train = spark.range(400).coalesce(1).select("id", x.alias("a"), (x * x).alias("b"))
    prepare.fit_transforms(train, "id", ["a", "b"], prepare.PrepConfig(reject_outliers=False))
    assert seen["prep-scaled"].rdd.getNumPartitions() >= 8 and seen["prep-scaled"].count() == 400
