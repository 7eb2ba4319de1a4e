"""Steps whose tasks or passes must not grow faster than their tables, on rows made here."""

import pyarrow as pa
from pyspark.sql import functions as F

from urlwarden.operators import online_logit
from urlwarden.plans import train
from urlwarden.session import workspace


def _labeled(spark):
    good = [(f"http://shop{i}.example.org/item/{i}", 0) for i in range(40)]
    bad = [(f"http://login-{i}.verify.tk/p{i}", 1) for i in range(40)]
    return spark.createDataFrame([*good, *bad, *bad[:5]], "url string, label int")


def test_training_rows_are_dealt_over_tasks(spark, monkeypatch):
    cfg = train.TrainConfig(char_terms=20, word_terms=10, forest_trees=2, forest_depth=2, boost_rounds=2, boost_depth=2,
                            extra_trees=2, extra_depth=2, cv_folds=2, task_rows=20)
    rows = train.training_set(_labeled(spark)).coalesce(1)
    seen, together = [], train._together
    stages = train.feature_stages
    monkeypatch.setattr(train, "feature_stages", lambda df, c: seen.append(df.rdd.getNumPartitions()) or stages(df, c))
    sizes = []
    monkeypatch.setattr(train, "_together", lambda s, n, work, items: sizes.append(len(items)) or together(s, n, work, items))
    train.fit_url_model(rows, cfg)
    assert seen == [4]
    path = workspace(spark, "run")
    told = train.train(_labeled(spark), path, cfg).first()
    # Two folds and the final model side by side, each with its three voters.
    assert sorted(sizes) == [3, 3, 3, 3, 3] and told["dataset_samples"] == 85
    assert sorted(r["fold"] for r in spark.read.parquet(f"{path}/cv").collect()) == [0, 1]
    scores = train.score_urls(train.load_model(f"{path}/model"), _labeled(spark))
    assert scores.count() == 85 and scores.where(F.col("probability").isNull()).count() == 0


def test_fits_side_by_side_share_the_cores(spark):
    cfg = train.TrainConfig(task_rows=20, most_rows=1000)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(20 * cores).select(F.col("id").cast("string").alias("id")).coalesce(1)
    assert train._dealt(rows, cfg).rdd.getNumPartitions() == cores
    assert train._dealt(rows, cfg, 2).rdd.getNumPartitions() == cores // 2
    assert train._dealt(rows, cfg, 2 * cores).rdd.getNumPartitions() == 1
    # A task holds a bounded number of rows, however many cores there are.
    assert train._dealt(rows, train.TrainConfig(task_rows=20, most_rows=5), 2).rdd.getNumPartitions() == 4 * cores


def test_rows_of_a_shard_are_cut_over_batches():
    rows = [(k // 7, [k] * (k % 3), float(k)) for k in range(20)]
    schema = pa.schema({"x": pa.list_(pa.int32()), "y": pa.float64(), "w": pa.float64(), "o": pa.int64(), "shard": pa.int64()})
    batches = [pa.RecordBatch.from_pylist([
        {"x": x or None, "y": y, "w": 1.0, "o": 0, "shard": s} for s, x, y in part], schema) for part in (rows[:3], rows[3:11], rows[11:11], rows[11:])]
    units = list(online_logit._unit_rows(iter(batches)))
    assert [u.column("v").to_pylist() for u in units][0] == [[], [1.0], [1.0]]  # two of one bucket are one of length 1
    parts = list(online_logit._parts(iter(units), 4))
    assert [(s, len(p[0]), list(p[3])) for s, p in parts] == [
        (0, 4, [0.0, 1.0, 2.0, 3.0]), (0, 3, [4.0, 5.0, 6.0]), (1, 4, [7.0, 8.0, 9.0, 10.0]), (1, 3, [11.0, 12.0, 13.0]),
        (2, 4, [14.0, 15.0, 16.0, 17.0]), (2, 2, [18.0, 19.0])]
    assert all(len(p[1]) == len(p[2]) == sum(p[0]) for _, p in parts)
