"""The stored log and its sums, address ranges, suffix tables and rank sums against plain ways."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlwarden.operators import allowlist, metrics, ranges, telemetry
from urlwarden.registry import corpora as C
from urlwarden.registry import queries as Q
from urlwarden.session import workspace
from urlwarden.sources import telemetry_store as store


def log_rows(spark, lo, hi):
    ids = spark.range(lo, hi)
    verdict = F.element_at(F.array(*[F.lit(v) for v in telemetry.VERDICTS]), (F.col("id") % 3 + 1).cast("int"))
    source = F.concat(F.lit("Tier-"), (F.col("id") % 4).cast("string"), F.lit(" x"))
    return ids.select(
        "id", F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), verdict.alias("verdict"), source.alias("source"),
        F.lit(0.5).alias("risk_score"), F.when(F.col("id") % 7 != 0, F.col("id") / 8).alias("latency"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("timestamp"), F.lit("8.8.8.8").alias("resolved_ip"),
        F.lit("o").alias("asn_owner"), F.lit(200).alias("http_status"),
        F.from_json(F.lit('{"summary": "s"}'), dict(store_fields())["forensics"]).alias("forensics"))


def store_fields():
    from pyspark.sql.types import _parse_datatype_string
    return [(f.name, f.dataType) for f in _parse_datatype_string(store.SCHEMA).fields]


def test_sums_say_what_the_rows_say(spark):
    root = workspace(spark, "log")
    assert store.read_log(spark, root).count() == 0 and store.newest(spark, root, 5).count() == 0
    empty = telemetry.stats_of_sums(store.read_sums(spark, root)).first()
    assert empty.asDict() == telemetry.stats(store.read_log(spark, root)).first().asDict()
    names = [store.append_log(log_rows(spark, lo, hi), root) for lo, hi in ((0, 100), (100, 250), (200, 230))]
    for _ in range(2):
        log, sums = store.read_log(spark, root), store.read_sums(spark, root)
        assert log.count() == 280
        assert telemetry.stats_of_sums(sums).first().asDict() == telemetry.stats(log).first().asDict()
        for got, want in ((telemetry.verdict_counts_of_sums(sums), telemetry.verdict_counts(log)),
                          (telemetry.tier_counts_of_sums(sums), telemetry.tier_counts(log))):
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        for n in (1, 50, 279, 1000):
            got = [r["id"] for r in store.newest(spark, root, n).collect()]
            assert got == sorted([*range(250), *range(200, 230)], reverse=True)[:n]
        # The job ended before the sums of an append were written.
        from urlwarden.session import delete_folder
        delete_folder(spark, f"{root}/sums/{names[1]}")
    store.write_sums(spark, root, names[1])
    assert len(store._complete(spark, f"{root}/sums")) == 3


def test_newest_rows_open_few_days(spark):
    root = workspace(spark, "log")
    store.append_log(log_rows(spark, 0, 24 * 40), root)
    files = store.newest(spark, root, 30).inputFiles()
    got = store.newest(spark, root, 30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(id" in plan
    days = {f.split("scan_date=")[1].split("/")[0] for f in files}
    opened = {r["scan_date"] for r in got.select("scan_date").collect()}
    assert len(days) >= len(opened) and opened <= {dt.date(2024, 2, 8), dt.date(2024, 2, 9)}


def test_reports_read_no_forensics(spark, sf_dir):
    for query in (Q.stats_all, Q.verdict_counts, Q.tier_counts, Q.log_detail, Q.incident_report, Q.log_recent):
        plan = query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "forensics" not in plan and "Python" not in plan
    assert C.stored_log(spark, sf_dir) == C.stored_log(spark, sf_dir)


def test_blocks_make_up_the_range(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(a + w)) for a, w in zip(rng.integers(0, 1000, 60), rng.integers(0, 300, 60))]
    rows += [(0, 2**32 - 1), (5, 2**32 - 1), (0, 0), (2**32 - 1, 2**32 - 1), (2**31 - 1, 2**31), (7, 6)]
    df = spark.createDataFrame(rows, "lo long, hi long").withColumn("b", ranges.blocks(F.col("lo"), F.col("hi")))
    for r in df.collect():
        spans = sorted((b["prefix"] << b["size"], (b["prefix"] + 1 << b["size"]) - 1) for b in r["b"])
        assert len(spans) <= 64 and all(y[0] == x[1] + 1 for x, y in zip(spans, spans[1:]))
        assert (spans[0][0], spans[-1][1]) == (r["lo"], r["hi"]) if r["lo"] <= r["hi"] else spans == []


def test_range_lookup_against_all_ranges(spark):
    rng = np.random.default_rng(4)
    table = [(int(a), int(a + w), f"o{i}") for i, (a, w) in enumerate(zip(rng.integers(0, 3000, 200), rng.integers(0, 90, 200)))]
    table += [(0, 2**32 - 1, "all"), (10, 5, "none"), (None, 4, "none"), (100, 110, "z"), (100, 110, "a")]
    asked = [(i, int(x)) for i, x in enumerate(rng.integers(0, 3200, 500))] + [(1000, None), (1001, 2**32 - 1)] + [(2000 + i, 105) for i in range(300)]
    got = ranges.match_ranges(spark.createDataFrame(asked, "id long, ip_number long"), spark.createDataFrame(table, "lo long, hi long, owner string"))
    for r in got.collect():
        fit = [(hi - lo, lo, o) for lo, hi, o in table if lo is not None and r["ip_number"] is not None and lo <= r["ip_number"] <= hi]
        assert r["owner"] == (min(fit)[2] if fit else None)
    assert got.count() == len(asked)
    none = spark.createDataFrame([], "lo long, hi long, owner string")
    assert ranges.match_ranges(spark.createDataFrame(asked, "id long, ip_number long"), none).where("owner IS NOT NULL").count() == 0


def test_addresses(spark):
    texts = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3", "1.2.3.4.5", "1.2.3.", "a.b.c.d", "", None, " 1.2.3.4", "01.2.3.4"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "ip string").select(ranges.ip_number(F.col("ip"))).collect()]
    assert got == [16909060, 2**32 - 1, 0] + [None] * 9


def test_longest_suffix(spark):
    hosts = ["a.example.com", "example.com", "xexample.com", "B.A.Example.COM", "com", "", None, "a..com", "a.example.com"]
    table = [" .Example.com. ", "a.example.com", "a.example.com", "", None, "com.", "org"]
    got = allowlist.suffix_match(spark.createDataFrame(list(enumerate(hosts)), "i int, domain string"),
                                 spark.createDataFrame([(t,) for t in table], "suffix string"))
    assert [r["suffix"] for r in got.orderBy("i").collect()] == [
        "a.example.com", "example.com", "com", "a.example.com", "com", None, None, "com", "a.example.com"]


@pytest.mark.parametrize("kind", ["edges", "even", "one"])
def test_rank_sums_of_crowded_scores(spark, kind):
    """Scores near 0 and 1 fill ranges as evenly as any others."""
    rng = np.random.default_rng(6)
    n = 4000
    s = {"edges": np.where(rng.random(n) < 0.5, rng.random(n) * 1e-7, 1 - rng.random(n) * 1e-7), "even": rng.random(n),
         "one": np.full(n, 0.25)}[kind]
    y = (rng.random(n) < 0.3 + 0.4 * (s > 0.5)).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    got = metrics.binary_metrics(df, "y", "s", F.col("s") >= 0.5).first()["roc_auc"]
    order = np.argsort(np.concatenate((s[y == 1], s[y == 0])))
    pos, neg = np.sort(s[y == 1]), np.sort(s[y == 0])
    wins = np.searchsorted(neg, pos, "left").sum() + 0.5 * (np.searchsorted(neg, pos, "right") - np.searchsorted(neg, pos, "left")).sum()
    assert len(order) == n and got == pytest.approx(wins / (len(pos) * len(neg)))
    sizes = [r["count"] for r in metrics.score_ranges(df.select("s").distinct()).groupBy("bucket").count().collect()]
    assert max(sizes) <= 3 * (len(set(s)) / 8) + 1
