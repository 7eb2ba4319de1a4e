"""Online logistic regression over hashed features: gradient steps in shards, weights averaged per epoch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlwarden.session import checkpoint


@dataclass(frozen=True)
class OnlineConfig:
    buckets: int = 1 << 18  # weights that the driver holds and sends: 2 MB
    epochs: int = 20
    alpha: float = 1e-4  # weight of the squared norm
    batch: int = 32  # rows a step
    shards: int = 16  # learners side by side
    seed: int = 42


def hashed(terms: Column, buckets: int) -> Column:
    """The bucket of each term; repeats stay."""
    return F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))


def _units(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and value of rows of buckets with repeats: counts scaled to unit length, in bucket order."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    pairs, count = np.unique(row << 32 | lists.flatten().to_numpy().astype(np.int64), return_counts=True)
    row, bucket = pairs >> 32, pairs & 0xFFFFFFFF
    norm = np.sqrt(np.bincount(row, count.astype("float64") ** 2, minlength=len(lists)))
    return row, bucket, count / norm[row]


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their distinct buckets and the values of these, so that no epoch makes them again."""
    for b in batches:
        row, bucket, value = _units(b.column("x"))
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(b))))).astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(a)) for a in (bucket.astype(np.int32), value)]
        yield pa.RecordBatch.from_arrays([*lists, *[b.column(c) for c in ("y", "w", "o", "shard")]], names=["x", "v", "y", "w", "o", "shard"])


def _parts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, tuple]]:
    """Shard and numbers of buckets, buckets, values, labels and weights of the next ``size`` rows of one shard, or of its last."""
    held, n, shard = [], 0, None
    whole = lambda: tuple(a[0] if len(a) == 1 else np.concatenate(a) for a in zip(*held))
    for b in batches:
        of, y, w = (b.column(c).to_numpy() for c in ("shard", "y", "w"))
        sizes = b.column("x").value_lengths().to_numpy()
        x, v = (b.column(c).flatten().to_numpy() for c in ("x", "v"))
        ends, at = np.concatenate(([0], np.cumsum(sizes))), 0
        while at < len(of):
            if of[at] != shard:
                if held:
                    yield shard, whole()
                held, n, shard = [], 0, of[at]
            to = min(int(np.searchsorted(of, shard, "right")), at + size - n)
            cut = slice(ends[at], ends[to])
            held.append((sizes[at:to], x[cut], v[cut], y[at:to], w[at:to]))
            n, at = n + to - at, to
            if n == size:
                yield shard, whole()
                held, n = [], 0
    if held:
        yield shard, whole()


def steps(weights: np.ndarray, bias: float, before: int, batches: Iterator, cfg: OnlineConfig) -> tuple[np.ndarray, float, int]:
    """Descend over batches of rows as ``_parts`` makes them; returns weights, bias and rows.

    A step moves against the mean gradient of its rows; the rate falls as 1 / (alpha * (t0 + steps))."""
    w, scale, t, seen = weights.copy(), 1.0, before, 0
    t0 = 1.0 / (sqrt(1.0 / sqrt(cfg.alpha)) * cfg.alpha)
    for sizes, bucket, value, labels, counts in batches:
        row = np.repeat(np.arange(len(sizes)), sizes)
        eta = 1.0 / (cfg.alpha * (t0 + t))
        margin = scale * np.bincount(row, w[bucket] * value, minlength=len(sizes)) + bias
        slope = eta * counts / counts.sum() * (1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))) - labels)
        scale *= 1.0 - eta * cfg.alpha  # the squared norm's part of the step, for all weights at once
        np.subtract.at(w, bucket, slope[row] * value / scale)
        bias -= float(slope.sum())
        t, seen = t + 1, seen + len(sizes)
        if scale < 1e-6:
            w, scale = w * scale, 1.0
    return w * scale, bias, seen


@dataclass
class OnlineLogit:
    weights: np.ndarray
    bias: float

    def score(self, df: DataFrame, terms: str, out: str = "probability") -> DataFrame:
        """Add the probability of label 1; null or empty terms have the bias alone."""
        shared = df.sparkSession.sparkContext.broadcast((self.weights, self.bias))

        def run(batches):
            w, bias = shared.value
            for batch in batches:
                lists = batch.column("_buckets")
                row, bucket, value = _units(lists)
                margin = np.bincount(row, w[bucket] * value, minlength=len(lists)) + bias
                found = pa.array(1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))))
                yield batch.drop_columns(["_buckets"]).append_column(out, found)

        rest = df.drop(out)
        rows = rest.withColumn("_buckets", hashed(F.col(terms), len(self.weights)))
        return rows.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(out, T.DoubleType())]))


def fit_online(df: DataFrame, id_col: str, terms: str, label: str, weight: str | None = None,
               cfg: OnlineConfig = OnlineConfig()) -> OnlineLogit:
    """Fit on all rows. Rows go to shards by a hash of their id and lie there in the order of another.

    Each epoch, every shard descends from the shared weights, batch by batch as its rows stream by;
    the next weights are the mean of the shards' weights by their rows, summed per bucket over the
    cluster. Only weights that a shard moved leave it. An empty table gives weights of 0."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(hashed(F.col(terms), cfg.buckets).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"),
                     F.xxhash64(F.lit(cfg.seed), F.col(id_col)).alias("o"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(cfg.shards)).alias("shard"))
    # Written as they lie, so that an epoch streams the rows in order without a shuffle.
    rows = rows.where("y IS NOT NULL").mapInArrow(_unit_rows, "x array<int>, v array<double>, y double, w double, o long, shard long")
    rows = checkpoint(rows.repartition(cfg.shards, "shard").sortWithinPartitions("shard", "o"))
    model, t = OnlineLogit(np.zeros(cfg.buckets), 0.0), 1
    for _ in range(cfg.epochs):
        shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.bias))

        def run(batches, shared=shared, t=t):
            start, bias = shared.value

            for _, parts in groupby(_parts(batches, cfg.batch), key=lambda p: p[0]):
                at, b0, seen = steps(start, bias, t, (p for _, p in parts), cfg)
                # Row -1 has the bias and the number of rows; a weight's change counts by the rows.
                moved = np.flatnonzero(at != start)
                yield pa.RecordBatch.from_pydict({
                    "bucket": np.concatenate(([-1], moved)), "sum": np.concatenate(([b0 * seen], (at[moved] - start[moved]) * seen)),
                    "n": np.concatenate(([seen], np.zeros(len(moved), np.int64)))})

        sums = rows.select("shard", "x", "v", "y", "w").mapInArrow(run, "bucket long, sum double, n long")
        found = sums.groupBy("bucket").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).toPandas()
        head, rest = found[found["bucket"] < 0], found[found["bucket"] >= 0]
        if not len(head):
            break
        total = int(head["n"].iloc[0])
        weights = model.weights.copy()
        weights[rest["bucket"].to_numpy()] += rest["sum"].to_numpy() / total
        model, t = OnlineLogit(weights, float(head["sum"].iloc[0]) / total), t + -(-total // (cfg.shards * cfg.batch))
    return model
