"""Golden features, properties of the score and the data meaning of the service tests."""

import math
import os
import re
import urllib.parse

import pytest
from pyspark.sql import functions as F

from urlwarden import fixed_values as V
from urlwarden.functions.lexical import Profile, url_features
from urlwarden.functions.risk import score, score_without_model_v3
from urlwarden.operators import allowlist, network, telemetry, verdicts
from urlwarden.plans import scan as scan_plan

FIXTURES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "FIXTURES.md")


def golden_rows():
    rows = []
    with open(FIXTURES, encoding="utf-8") as f:
        for line in f:
            cells = line.rstrip("\n").split("|")[1:-1]
            if line.startswith("| `") and len(cells) == 10:
                url = re.match(r" `(.*)` $", cells[0]).group(1)
                rest = [c.strip().strip("`") for c in cells[1:]]
                rows.append((url, rest[0], float(rest[1]), int(rest[2]), float(rest[3]), int(rest[4]),
                             int(rest[5]), int(rest[6]), float(rest[7]), rest[8]))
    return rows


def test_golden(spark):
    want = golden_rows()
    assert len(want) == 32
    df = spark.createDataFrame([(r[0],) for r in want], "url string")
    got = {r["url"]: r for r in score(url_features(df)).collect()}
    for url, host, ent, brand, dga, lures, tld, ip, risk, verdict in want:
        r = got[url]
        assert (r["host"], round(r["entropy"], 4), r["brand_dist"], r["dga_score"]) == (host, ent, brand, dga), url
        assert (len(r["lure_matches"]), r["has_suspicious_tld"], r["has_ip"]) == (lures, tld, ip), url
        assert (r["risk_score"], r["verdict"]) == (risk, verdict), url


def test_score_properties(spark):
    urls = [r[0] for r in golden_rows()]
    pairs = [(u, "raw") for u in urls] + [(f" \t{u.upper()}\n", "noisy") for u in urls if u.isascii()]
    df = score(url_features(spark.createDataFrame(pairs, "url string, kind string")))
    rows = df.collect()
    by_url = {r["canonical"]: r for r in rows if r["kind"] == "raw"}
    for r in rows:
        assert 0.01 <= r["risk_score"] <= 0.99
        assert 0 <= r["entropy"] <= math.log2(max(1, r["domain_length"])) + 1e-9
        if r["kind"] == "noisy":
            assert r["verdict"] == by_url[r["canonical"]]["verdict"]


def test_model_probability_wins(spark):
    df = spark.createDataFrame([("http://paypa1.com/", 0.1), ("http://paypa1.com/", None)], "url string, p double")
    got = score(url_features(df), probability="p").select("risk_score", "verdict").collect()
    assert [tuple(r) for r in got] == [(0.1, "SAFE"), (0.85, "MALICIOUS")]


def test_v3_without_model(spark):
    row = score_without_model_v3(spark.createDataFrame([("http://a.b",)], "url string")).first()
    assert (row["verdict"], row["risk_score"]) == ("UNKNOWN", 0.0)


def test_brand_list_is_bounded():
    with pytest.raises(ValueError):
        Profile("big", [f"brand{i}" for i in range(1000)], [], [])


def requests(spark, urls):
    rows = [(i, u) for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "scan_id bigint, url string").withColumn(
        "ts", F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, scan_id)"))


def test_service_checks(spark):
    phish = "http://paypa1-security-center.account-verification-dispatch.info"
    batch = requests(spark, ["https://www.presidencyuniversity.in", phish, phish.upper(), "  ", None,
                             "http://[::1/x", "http://free-crypto-giveaway-claim-now.site/claim"])
    results = {r["scan_id"]: r for r in scan_plan.scan_batch(batch).collect()}
    assert (results[0]["verdict"], results[0]["source"]) == ("SAFE", V.SOURCE_ALLOW)
    assert results[1]["verdict"] in ("MALICIOUS", "SUSPICIOUS") and results[1]["source"] == V.SOURCE_SCORER
    assert (results[2]["source"], results[2]["verdict"]) == (V.SOURCE_CACHE, results[1]["verdict"])
    assert set(results) == {0, 1, 2, 6}
    _, rejects = scan_plan.split_requests(batch)
    assert {r["scan_id"]: r["reason"] for r in rejects.collect()} == {
        3: "blank url", 4: "blank url", 5: "unbalanced brackets in host"}
    assert scan_plan.batch_report(scan_plan.scan_batch(batch)).first()[0] == 4


@pytest.mark.parametrize("url", [
    "[foo", "abc[def. x", "evil.com/?u=http://[x", "http://[abc]/x", "http://[::1]/x", "http://[::1", "http://[1:2:3:4:5:6:7:8]:80", "http://[1::8]x",
    "http://u:p@[::ffff:1.2.3.4]/", "http://[::1.2.3.400]/", "http://[v1.x]/", "http://[vx]/", "http://x[::1]/", "http://[1:2:3:4:5:6:7::]",
    "http://[1::2:3:4:5:6:7:8]", "http://[::1%eth0]/", "http://[::1%]/", "http://[12345::]", "//[::]", "http://a[b]@c/", "http://[a]@[::1]/",
    "a/[b]", "http://\u2100.com/", "http://ok.com/\u2100", "http:[x", "HTTP://[FE80::1]/", "http://[1.2.3.4]/", "x://y?[", "http://a\uff03b/"])
def test_rejects_as_the_url_parser(spark, url):
    full = url.strip().lower()
    full = full if "://" in full else "http://" + full
    try:
        urllib.parse.urlparse(full)
        bad = False
    except ValueError:
        bad = True
    row = spark.createDataFrame([(url,)], "url string").select(scan_plan.reject_reason(F.col("url")).alias("r")).first()
    assert (row["r"] is not None) == bad


def test_cache_life(spark):
    scored = score(url_features(requests(spark, ["http://paypa1.com/", "http://10.0.0.1/admin"])))
    entries = verdicts.new_entries(scored, F.col("ts"))
    assert verdicts.purge_verdicts(entries).count() == 0
    gone = spark.createDataFrame([(" HTTP://PAYPA1.com/ ",)], "url string")
    left = verdicts.purge_verdicts(entries, gone)
    assert [r["url"] for r in left.collect()] == ["http://10.0.0.1/admin"]
    later = verdicts.new_entries(scored, F.col("ts") + F.expr("interval 1 hour"))
    merged = verdicts.upsert_verdicts(entries, later)
    assert merged.count() == 2 and merged.agg(F.min("cached_at")).first() == later.agg(F.min("cached_at")).first()
    now = F.lit("2024-01-01 01:00:02").cast("timestamp")
    assert [r["verdict"] for r in verdicts.expire_verdicts(entries, now).collect()] == ["MALICIOUS"]


def test_lookup_takes_the_newest_entry(spark):
    """A newer entry replaces an older one, also when it expires first."""
    entries = spark.createDataFrame(
        [("x", "http://x/", "MALICIOUS", 0.9, "2024-01-01 00:00:00", "2024-01-02 00:00:00"),
         ("x", "http://x/", "SUSPICIOUS", 0.5, "2024-01-01 10:00:00", "2024-01-01 11:00:00")],
        "k string, url string, verdict string, risk_score double, a string, b string")
    entries = entries.select(F.sha2(F.col("url"), 256).alias("url_hash"), "url", "verdict", "risk_score",
                             F.to_timestamp("a").alias("cached_at"), F.to_timestamp("b").alias("expires_at"))
    times = ["2023-12-31 23:59:59", "2024-01-01 00:00:00", "2024-01-01 09:59:59", "2024-01-01 10:00:00",
             "2024-01-01 11:00:00", "2024-01-01 11:00:01", "2024-01-01 23:00:00"]
    scans = spark.createDataFrame([(i, "HTTP://X/", t) for i, t in enumerate(times)], "scan_id bigint, url string, t string")
    got = verdicts.lookup_verdicts(scans.withColumn("ts", F.to_timestamp("t")), entries)
    assert [r["cached_verdict"] for r in got.orderBy("scan_id").collect()] == [
        None, "MALICIOUS", "MALICIOUS", "SUSPICIOUS", "SUSPICIOUS", None, None]


def test_allow_rules(spark):
    urls = {"http://google.com:pw@evil.com/": (True, False), "https://mail.google.com": (True, True),
            "https://xn--google.com": (False, False), "http://a.b.gov.in/x": (True, True),
            "http://gоogle.com": (False, False), "http://x.iitm.ac.in": (True, True), "http://evil.com": (False, False)}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    loose = {r["url"]: r["allowed"] for r in allowlist.allow_decision(df).collect()}
    strict = {r["url"]: r["allowed"] for r in allowlist.allow_decision(df, strict=True).collect()}
    assert {u: (loose[u], strict[u]) for u in urls} == urls
    table = allowlist.allow_table(spark, spark.createDataFrame([("evil.com",)], "domain string"))
    assert allowlist.allow_decision(df, table).where("url = 'http://evil.com'").first()["allowed"]


def test_network_defaults(spark):
    df = spark.createDataFrame([("http://a.b/", "MALICIOUS", None, None)],
                               "url string, verdict string, resolved_ip string, asn_owner string")
    assert network.default_network(df).first()["resolved_ip"] == "185.220.101.5"
    dns = spark.createDataFrame([("a.b", "9.9.9.9")], "host string, ip string")
    got = network.enrich_network(df.drop("resolved_ip", "asn_owner"), dns, dialect="storage").first()
    assert got["asn_owner"] == "AS-RESOLVED (9.9.9.9 ISP Edge)"


def test_empty_log(spark):
    log = spark.createDataFrame([], "id bigint, verdict string, source string, latency double")
    row = telemetry.stats(log).first()
    assert row["total_scans"] == 0 and row["avg_latency_ms"] == 0.0 and row["tier1_redis_cache"] == 0
    assert telemetry.stats_v3(log).first()["malicious_detected"] == 0
    assert telemetry.log_detail(log, 999999).count() == 0
