"""The ways taken for hot keys, copies and large tables give the results of the plain ways."""

import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from urlwarden.operators import (metrics, neighbours, outliers, quantiles, replay, resample, scaling, split,
                                 verdicts)
from urlwarden.registry import corpora as C
from urlwarden.registry import queries as Q
from urlwarden.sources import labeled, telemetry_store
from urlwarden.streaming.scan_stream import start_scan_stream
from urlwarden.streaming.ttl_stream import replay_batch, start_ttl_stream
from urlwarden.session import workspace


def skewed_scans(spark, n=3000):
    """A third of the scans belong to one key; times repeat."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string")))
    ttl = F.when(F.col("id") % 3 == 0, 3600).when(F.col("id") % 40 < 20, 43200).otherwise(86400)
    ts = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.xxhash64("id"), F.lit(2000)) * 60)
    return spark.range(n).select(F.col("id").alias("scan_id"), key.alias("url_hash"), ts.alias("ts"), ttl.alias("ttl"))


def brute_replay(rows):
    expiry, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["scan_id"])):
        t = r["ts"].timestamp()
        hit = t <= expiry.get(r["url_hash"], -1)
        if not hit:
            expiry[r["url_hash"]] = t + r["ttl"]
        out[r["scan_id"]] = int(hit)
    return out


def as_dict(df, value="hit"):
    return {r["scan_id"]: r[value] for r in df.collect()}


@pytest.mark.parametrize("partitions, fan, keys", [(8, 32, "all"), (40, 3, "all"), (40, 2, "hot"), (3, 2, "hot"), (1, 2, "all")])
def test_replay_of_hot_keys(spark, monkeypatch, partitions, fan, keys):
    """One key fills many ranges, whose functions are combined in several rounds."""
    monkeypatch.setattr(replay, "FAN", fan)
    scans = skewed_scans(spark)
    scans = scans.where("url_hash = 'hot'") if keys == "hot" else scans
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = as_dict(replay.ttl_replay(scans))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute_replay(scans.collect())


def test_replay_of_a_null_key_ties_and_nothing(spark):
    rows = [(i, None if i % 2 else "a", f"2024-01-01 00:00:{i // 4:02d}", 3) for i in range(80)]
    scans = spark.createDataFrame(rows, "scan_id long, url_hash string, at string, ttl int").selectExpr(
        "scan_id", "url_hash", "cast(at as timestamp) as ts", "ttl")
    assert as_dict(replay.ttl_replay(scans)) == brute_replay(scans.collect())
    assert as_dict(replay.ttl_replay(scans.limit(0))) == {}


def test_steps_are_the_replay_of_a_range():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, ttl = int(rng.integers(1, 40)), int(rng.integers(0, 30))
        ranges = [np.sort(rng.integers(a * 50, a * 50 + 50, n)) for a in range(3)]

        def chain(e, t):
            for x in t:
                e = x + ttl if x > e else e
            return e

        steps = [replay.range_steps(t, ttl) for t in ranges]
        for e in range(-60, int(ranges[0][0]) + ttl + 1):
            assert replay.apply_steps(np.array([e]), *steps[0])[0] == chain(e, ranges[0])
        frames = [pd.DataFrame({"place": i, "_group": 0, "upto": u, "out": o}) for i, (u, o) in enumerate(steps)]
        (whole,) = replay._combine(iter(frames))
        assert len(whole) <= sum(map(len, frames))
        for e in (-60, int(ranges[0][0]) - 1, int(ranges[0][0]), int(ranges[0][0]) + ttl):
            assert replay.apply_steps(np.array([e]), whole["upto"].to_numpy(), whole["out"].to_numpy())[0] == chain(e, np.concatenate(ranges))


def test_a_year_of_hourly_spans_takes_few_jobs(spark):
    """8,760 spans of one key; the number of jobs does not follow the number of spans."""
    ids = spark.range(60000, numPartitions=8)
    ts = F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("id") * 365 * 86400 / 60000))
    scans = ids.select(F.col("id").alias("scan_id"), F.lit("k").alias("url_hash"), ts.alias("ts"), F.lit(3600).alias("ttl"))
    context = spark.sparkContext
    context.setJobGroup("year", "replay of a year")
    try:
        got = as_dict(replay.ttl_replay(scans))
        jobs = context.statusTracker().getJobIdsForGroup("year")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == brute_replay(scans.collect())
    assert sum(1 - h for h in got.values()) > 7000 and 0 < len(jobs) < 20


def test_stream_batches_continue_the_replay(spark):
    scans = skewed_scans(spark, 1500)
    root, out = workspace(spark, "batches"), {}
    cut = F.pmod(F.unix_seconds("ts"), F.lit(1 << 40))
    ends = scans.agg(F.min(cut), F.max(cut)).first()
    step = (ends[1] - ends[0]) // 3 + 1
    for i in range(3):
        lo = ends[0] + i * step
        batch = scans.where((cut >= lo) & (cut < lo + step))
        done = replay_batch(batch, i, root)
        out.update(as_dict(done))
        if i == 1:  # a batch that runs again gives the same result
            assert as_dict(replay_batch(batch, i, root)) == as_dict(done)
    assert out == brute_replay(scans.collect())


def fed(spark, parts):
    """A stream of the tables, one after the other, a table per micro-batch."""
    path = workspace(spark, "fed")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def brute_stream(batches):
    """Batch by batch; scans before the newest time of earlier batches only look."""
    entry, out, seen = {}, {}, None
    for rows in batches:
        at = lambda r: r["ts"].timestamp()
        late = [r for r in rows if seen is not None and at(r) < seen]
        for r in late:
            e = entry.get(r["url_hash"])
            out[r["scan_id"]] = int(e is not None and e[0] <= at(r) <= e[1])
        for r in sorted((r for r in rows if r not in late), key=lambda r: (r["ts"], r["scan_id"])):
            e = entry.get(r["url_hash"])
            hit = e is not None and at(r) <= e[1]
            if not hit:
                entry[r["url_hash"]] = (at(r), at(r) + r["ttl"])
            out[r["scan_id"]] = int(hit)
        seen = max([at(r) for r in rows] + ([seen] if seen is not None else []))
    return out


def state_bytes(root, version):
    return sum(f.stat().st_size for f in Path(root, "checkpoint/state").rglob(f"{version}*.changelog"))


def test_state_store_follows_the_keys_of_a_batch(spark):
    """Seven batches, some out of order: hits as by a plain replay, few bytes for few keys, timers end entries."""
    base = 1704067200
    def part(ids, key, at, ttl=3600):
        return ids.select(F.col("id").alias("scan_id"), key.alias("url_hash"), F.timestamp_seconds(at).alias("ts"), F.lit(ttl).alias("ttl"))

    key = F.concat(F.lit("k"), F.pmod(F.xxhash64("id"), F.lit(3000)).cast("string"))
    few = F.concat(F.lit("k"), (F.col("id") % 20).cast("string"))
    at = lambda lo, width: F.lit(base + lo) + F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(width))
    parts = [part(spark.range(0, 8000), key, at(0, 1800)), part(spark.range(8000, 8100), few, at(2000, 600)),
             part(spark.range(8100, 8200), few, at(1000, 1700)), part(spark.range(8200, 8300), few, at(2700, 3000)),
             part(spark.range(8300, 8400), few, at(1500, 5000)), part(spark.range(8400, 8500), few, at(9000, 600)),
             part(spark.range(8500, 8600), few, at(30000, 10))]
    root = workspace(spark, "store")
    query = start_ttl_stream(fed(spark, parts), root, buckets=1 << 20)
    query.awaitTermination()
    got = as_dict(spark.read.parquet(f"{root}/out"))
    assert got == brute_stream([p.collect() for p in parts])
    written = [state_bytes(root, v) for v in range(1, 5)]
    assert written[0] > 50_000 and max(written[1:]) < written[0] / 10
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) > 2500 and kept[-1] <= 20  # timers dropped the entries no scan can hit


def test_late_scans_and_rows_without_a_time_on_the_stream(spark):
    schema = "scan_id long, at string, url_hash string, ttl int"
    def part(*rows):
        return spark.createDataFrame(rows, schema).selectExpr("scan_id", "cast(at as timestamp) as ts", "url_hash", "ttl")

    parts = [part((1, "2024-01-01 00:00:10", "a", 60)),
             part((2, "2024-01-01 00:00:09", "a", 60), (3, "2024-01-01 00:00:11", "a", 60), (4, "2024-01-01 00:00:09", "b", 60),
                  (5, None, "a", 60)),
             part((6, "2024-01-01 00:00:10.5", "a", 60), (7, "2024-01-01 00:00:10.5", None, 60))]
    root = workspace(spark, "late-stream")
    start_ttl_stream(fed(spark, parts), root).awaitTermination()
    assert as_dict(spark.read.parquet(f"{root}/out")) == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0}


def test_a_stream_that_starts_again_goes_on(spark):
    scans = skewed_scans(spark, 600)
    cut = F.unix_seconds("ts")
    middle = scans.agg(F.avg(cut)).first()[0]
    parts, root = [scans.where(cut < middle), scans.where(cut >= middle)], workspace(spark, "again")
    path = workspace(spark, "again-fed")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        start_ttl_stream(spark.readStream.schema(scans.schema).parquet(path), root, buckets=5).awaitTermination()
    assert as_dict(spark.read.parquet(f"{root}/out")) == brute_replay(scans.collect())


def test_late_rows_read_the_state(spark):
    root = workspace(spark, "late")
    rows = spark.sql("""select 1L as scan_id, timestamp'2024-01-01 00:00:10' as ts, 'a' as url_hash, 60 as ttl""")
    assert as_dict(replay_batch(rows, 0, root)) == {1: 0}
    later = spark.sql("""select * from values (2L, timestamp'2024-01-01 00:00:09', 'a', 60), (3L, timestamp'2024-01-01 00:00:11', 'a', 60),
                         (4L, timestamp'2024-01-01 00:00:09', 'b', 60) t(scan_id, ts, url_hash, ttl)""")
    assert as_dict(replay_batch(later, 1, root)) == {2: 0, 3: 1, 4: 0}
    assert as_dict(replay_batch(rows.selectExpr("5L as scan_id", "timestamp'2024-01-01 00:00:10.5' as ts", "url_hash", "ttl"), 2, root)) == {5: 1}


def test_every_scan_of_an_unordered_stream_is_told(spark, sf_dir):
    root, feed = workspace(spark, "unordered"), workspace(spark, "unordered-feed")
    scans = C.scan_requests(spark, sf_dir).select("scan_id", "ts", "url", "latency")
    for i in (2, 0, 3, 1):  # files in another order than the times in them
        scans.where(F.pmod(F.floor(F.unix_seconds("ts") / 400000), F.lit(4)) == i).write.mode("append").parquet(feed)
    source = spark.readStream.schema(scans.schema).option("maxFilesPerTrigger", 3).parquet(feed)
    start_scan_stream(source, root, delay="1 hour").awaitTermination()
    ids = [r["scan_id"] for r in spark.read.parquet(f"{root}/telemetry").select("scan_id").collect()]
    assert len(ids) == len(set(ids)) == scans.count()


def test_lookup_grows_with_the_log_on_one_hot_url(spark):
    """One URL has nearly all scans and entries within hours; rows meet their entry, never pairs."""
    def tables(n):
        ids = spark.range(n, numPartitions=8)
        url = F.when(F.col("id") % 100 == 0, F.concat(F.lit("http://x/"), F.col("id").cast("string"))).otherwise("http://hot/")
        ts = F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 50000)
        scans = ids.select(F.col("id").alias("scan_id"), ts.alias("ts"), url.alias("url"))
        entries = ids.where("id % 10 = 1").select(
            F.sha2(F.lower(url), 256).alias("url_hash"), url.alias("url"), F.concat(F.lit("V"), (F.col("id") % 7).cast("string")).alias("verdict"),
            F.lit(0.5).alias("risk_score"), ts.alias("cached_at"), (ts + F.expr("interval 2 seconds")).alias("expires_at"))
        return scans, entries

    scans, entries = tables(3000)
    got = {r["scan_id"]: r["cached_verdict"] for r in verdicts.lookup_verdicts(scans, entries).collect()}
    for i in range(3000):
        last = max((j for j in range(max(1, i - 60), i + 1) if j % 10 == 1 and j % 100 != 0), default=None) if i % 100 else None
        assert got[i] == (f"V{last % 7}" if last is not None and (i - last) * 50 <= 2000 else None)
    seconds = []
    for n in (100_000, 400_000):
        scans, entries = tables(n)
        start = time.time()
        verdicts.lookup_verdicts(scans, entries).write.format("noop").mode("overwrite").save()
        seconds.append(time.time() - start)
    assert seconds[1] < 5 * seconds[0] + 5


def brute_knn(ids, x, k):
    d = np.round(((x[:, None] - x[None]) ** 2).sum(-1), neighbours.DIGITS)
    np.fill_diagonal(d, np.inf)
    return {int(i): [int(ids[j]) for j in np.lexsort((ids, d[n]))[:k]] for n, i in enumerate(ids)}


@pytest.mark.parametrize("k", [1, 5])
def test_knn_with_copies(spark, monkeypatch, k):
    """Exact, also where a third of the points are copies of one vector and blocks are tiny."""
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 10)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 3)), 1)
    x[::3] = [0.5, 0.5, 0.5]
    ids = rng.permutation(300)
    points = spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)],
                                   "id bigint, vec array<double>")
    near = neighbours.knn(points, k).collect()
    got = {}
    for r in sorted(near, key=lambda r: r["rank"]):
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == brute_knn(ids, x, k)


@pytest.mark.parametrize("kind", ["smooth", "heavy", "two values"])
def test_exact_quantiles_by_narrowing(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    x = F.pmod(F.xxhash64("id"), F.lit(100003)).cast("double")
    if kind == "heavy":
        x = F.when(F.col("id") % 3 == 0, 500.0).otherwise(F.exp(x / 5000))
    elif kind == "two values":
        x = F.col("id") % 2 + 0.0
    df = spark.range(4000).select(x.alias("x"))
    probs = [0.0, 0.02, 0.25, 0.5, 0.75, 1.0]
    monkeypatch.setattr(quantiles, "HELD", 10)
    want = np.quantile(np.array([r["x"] for r in df.collect()]), probs)
    assert quantiles.exact_quantiles(df, ["x"], probs, held=10)["x"] == pytest.approx(want, abs=1e-9)


def test_split_is_exact_per_class(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") < 90).cast("int").alias("y"))
    sizes = {(r["y"], r["split"]): r["count"] for r in split.split(df, "id", "y").groupBy("y", "split").count().collect()}
    assert sizes == {(1, "test"): 18, (1, "val"): 9, (1, "train"): 63, (0, "test"): 182, (0, "val"): 91, (0, "train"): 637}
    folds = split.folds(df, "id", "y").groupBy("fold", "y").count().collect()
    assert {(r["fold"], r["y"]): r["count"] for r in folds} == {
        **{(i, 1): 18 for i in range(5)}, **{(i, 0): 182 for i in range(5)}}
    for n in (0, 7, 90):
        assert split.pick_exactly(df.where("y = 1"), "id", n, 1).where("picked").count() == n


def two_classes(spark, n=200, minority=30):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    x[:minority] += 1.0
    rows = [(i, [float(v) for v in x[i]], int(i < minority)) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, label int")


def test_resampling(spark):
    df = two_classes(spark)
    one, two = (sorted(map(str, resample.smote(df).collect())) for _ in range(2))
    assert one == two
    counts = {r["label"]: r["n"] for r in resample.class_counts(resample.smote(df)).collect()}
    assert counts == {0: 170, 1: 170}
    assert resample.smote(df).select("id").distinct().count() == 340
    cleaned = resample.smote_tomek(df)
    assert neighbours.tomek_links(resample.smote(df)).count() * 2 == 340 - cleaned.count()
    grown = {r["label"]: r["n"] for r in resample.class_counts(resample.adasyn(df)).collect()}
    assert grown[0] == 170 and abs(grown[1] - 170) <= 30


def test_forest_finds_the_far_points(spark):
    df = two_classes(spark).select("id", "vec")
    far = spark.createDataFrame([(1000, [30.0, 30.0]), (1001, [-40.0, 10.0])], "id bigint, vec array<double>")
    rows = df.union(far)
    marked = outliers.fit_forest(rows, 0.02).inliers(rows)
    out = {r["id"] for r in marked.where(~F.col("is_inlier")).collect()}
    assert {1000, 1001} <= out and len(out) <= 5


def test_area_under_curve(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 500), np.round(rng.random(500), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    got = metrics.binary_metrics(df, "y", "s", F.col("s") >= 0.5).first()
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()
    assert got["roc_auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    assert got["accuracy"] == pytest.approx(((s >= 0.5) == (y == 1)).mean())


def test_constant_columns(spark):
    df = spark.range(10).select(F.lit(3.0).alias("c"), F.col("id").cast("double").alias("x"))
    assert scaling.fit_standard(df, ["c"])["c"][1] == 1.0
    assert scaling.fit_robust(df, ["c"])["c"][1] == 1.0
    assert scaling.fit_power(df, ["c"])["c"] == 1.0


def test_snapshots_and_csv(spark):
    root = workspace(spark, "snap")
    schema = "a bigint"
    assert telemetry_store.read_snapshot(spark, root, schema) is None
    telemetry_store.write_snapshot(spark.range(2).toDF("a"), root, 1)
    telemetry_store.write_snapshot(spark.range(3).toDF("a"), root, 2)
    assert telemetry_store.read_snapshot(spark, root, schema).count() == 3
    assert telemetry_store.read_snapshot(spark, root, schema, before=2).count() == 2
    path = workspace(spark, "csv")
    rows = spark.createDataFrame([(' a,"b" ', 1), ("é|x", 0)], "url string, label int")
    labeled.write_labeled_urls(rows, path)
    assert sorted(map(tuple, labeled.read_labeled_urls(spark, path).collect())) == [(' a,"b" ', 1), ("é|x", 0)]


def test_skewed_lookup_is_split(spark, sf_dir):
    """With small limits the adaptive planner splits the hot side of the lookup join."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
             "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
             "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        from urlwarden.operators.network import enrich_network
        base = spark.range(0, 30000, 1, 8)
        url = F.when(F.col("id") % 3 == 0, "http://hot.example/").otherwise(
            F.concat(F.lit("http://h"), F.col("id").cast("string"), F.lit(".example/")))
        scans = base.select(F.col("id").alias("scan_id"), url.alias("url"))
        dns = base.select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example")).alias("host"),
                          F.lit("8.8.8.8").alias("ip"))
        done = enrich_network(scans, dns)
        assert done.count() == 30000
        done.collect()
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_text_features_of_edge_texts(spark):
    from urlwarden.functions.text import text_features
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Aa1! é²"), (4, "aaaa")], "id int, t string")
    got = {r["id"]: r for r in text_features(df, "t").collect()}
    assert got[1]["char_length"] == 0 and got[2]["shannon_entropy"] == 0.0
    assert (got[3]["digit_ratio"], got[3]["uppercase_ratio"]) == (round(2 / 7, 5), round(1 / 7, 5))
    assert got[4]["shannon_entropy"] == 0.0


def test_cascade_covers_the_input(spark, sf_dir):
    log = C.telemetry(spark, sf_dir)
    tiers = {r["tier"]: r["n"] for r in Q.tier_counts(spark, sf_dir).collect()}
    assert {"Tier-2", "Tier-3"} <= set(tiers) <= {"Tier-1", "Tier-2", "Tier-3"}
    assert sum(tiers.values()) == C.scan_requests(spark, sf_dir).count() == log.select("id").distinct().count()
