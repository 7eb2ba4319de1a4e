"""URL tables that Spark derives from the given tables; every query reads one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlwarden import fixed_values as V
from urlwarden.functions.lexical import url_features
from urlwarden.functions.risk import score
from urlwarden.functions.text import literals, text_features
from urlwarden.operators import verdicts
from urlwarden.plans import scan as scan_plan
from urlwarden.session import fingerprint_of, scratch, shared

TEMPLATES = V.BENIGN_URLS + V.PHISHING_URLS
HOST_TLDS = [".com", ".xyz", ".top", ".tk", ".ru", ".cn", ".info", ".org", ".net", ".io",
             ".in", ".ac.in", ".gov.in", ".co.uk", ".click", ".club", ".online", ".edu.in",
             ".gov", ".buzz"]
# What comes before and after the first word of a piece, to make requests with brackets.
BRACKET_FORMS = [("[", ""), ("abc[def. ", ""), ("evil.com/?u=http://[", ""), ("http://[", "]/x"), ("http://[::1]/", ""),
                 ("[2001:db8::", "]"), ("http://u@[1:2:3:4:5:6:7:8]:80/", ""), ("http://[1::", "]x"), ("x]", "")]
IP_PREFIXES = ["104.", "185.", "192.", "8."]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BUCKET_BYTES = 4 << 20  # stored bytes of the tables whose n-grams are summed at once
PART_BYTES = 8 << 20  # stored bytes of a table that one task gets: more rows make more tasks, not longer ones


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table is read from."""
    spark = df.sparkSession
    configuration, path_of = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    stored = 0
    for name in df.inputFiles():
        place = path_of(spark._jvm.java.net.URI(name))
        stored += place.getFileSystem(configuration).getFileStatus(place).getLen()
    return stored


def spread(df: DataFrame) -> DataFrame:
    """Deal a table over whole rounds of all cores, a large one over more tasks of bounded size, before heavy work on its rows.

    The splits of a file tell nothing: a row group is read by one of them, and the others stay empty.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-stored_bytes(df) // (PART_BYTES * cores))))


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(literals(values), (index + 1).cast("int"))


def scan_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan request per event: a sample URL, plain, upper-cased, padded or with a path."""
    e = spread(table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value"))
    n = len(TEMPLATES)
    base = _pick(TEMPLATES, F.col("event_id") % n)
    variant = F.floor(F.col("event_id") / n) % 4
    url = (F.when(variant == 0, base)
           .when(variant == 1, F.upper(base))
           .when(variant == 2, F.concat(F.lit("  "), base, F.lit("  ")))
           .otherwise(F.concat(base, F.lit("/p"), F.col("user_id").cast("string"))))
    label = F.when(F.col("event_id") % n < len(V.BENIGN_URLS), 0).otherwise(1)
    return e.select(
        F.col("event_id").alias("scan_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        url.alias("url"),
        F.col("value").alias("latency"),
        label.alias("label"),
        (F.col("event_id") % n).alias("template"),
        "event_type",
    )


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages").select(F.col("page_id").alias("url_id"), "url"))


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document, as a raw request line."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.select((F.col("doc_id") * 1000000 + F.col("line_no")).alias("url_id"),
                        "doc_id", "line_no", "line")


def doc_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One URL per document line: two words and a TLD as host, the other words as path."""
    lines = doc_lines(spark, sf_dir)
    line = F.col("line")
    w1 = F.split_part(line, F.lit(" "), F.lit(1))
    w2 = F.split_part(line, F.lit(" "), F.lit(2))
    rest = F.substring(line, F.length(w1) + F.length(w2) + 3, F.length(line))
    tld = _pick(HOST_TLDS, (F.col("doc_id") + F.col("line_no")) % len(HOST_TLDS))
    url = F.concat(F.lit("http://"), F.rtrim(F.concat(w1, F.lit("-"), w2), F.lit("-")), tld,
                   F.lit("/"), F.replace(rest, F.lit(" "), F.lit("-")))
    return lines.select("url_id", url.alias("url"))


def frequent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of five letters or more that at least every hundredth document has, as a brand table."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0)))).alias("brand"))
    counts = words.groupBy("brand").agg(F.count("*").alias("n"))
    return counts.join(d.agg(F.count("*").alias("docs"))).where("n * 100 >= docs").select("brand")


def all_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan requests, page URLs and document URLs in one table."""
    scans = scan_requests(spark, sf_dir).select(
        F.lit("scan").alias("corpus"), F.col("scan_id").alias("url_id"), "url")
    pages = page_urls(spark, sf_dir).select(F.lit("page").alias("corpus"), "url_id", "url")
    docs = doc_urls(spark, sf_dir).select(F.lit("doc").alias("corpus"), "url_id", "url")
    return scans.unionByName(pages).unionByName(docs)


def scored_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(url_features(scan_requests(spark, sf_dir)))


def cacheable_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored scans the allow-list does not know; only they reach the cache."""
    scans = scan_requests(spark, sf_dir)
    return scan_plan.scored_requests(scans).where(~F.col("allowed"))


def verdict_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries the scorer wrote one second after each sign-up event."""
    scored = cacheable_scans(spark, sf_dir).where(F.col("event_type") == "signup")
    return verdicts.new_entries(scored, F.col("ts") + F.expr("INTERVAL 1 SECOND"))


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passive-DNS table: one address per scanned host, none for every seventh sample URL."""
    from urlwarden.functions.urls import network_host

    s = scan_requests(spark, sf_dir).where(F.col("template") % 7 != 0)
    ip = F.concat(_pick(IP_PREFIXES, F.col("template") % 4), F.lit("0.0."),
                  F.col("template").cast("string"))
    host = F.lower(network_host(F.btrim("url")))
    return s.groupBy(host.alias("host")).agg(F.min(ip).alias("ip"))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan log: the cascade over all scan requests in time, with the network columns."""
    from urlwarden.operators.network import enrich_network

    scans = scan_requests(spark, sf_dir)
    results, _ = scan_plan.scan_over_time(scans)
    results = enrich_network(results, dns(spark, sf_dir))
    return results.select(
        F.col("scan_id").alias("id"), F.btrim("url").alias("url"), "verdict", "source",
        "risk_score", "latency", F.col("ts").alias("timestamp"), "resolved_ip", "asn_owner",
        F.lit(200).alias("http_status"), "forensics")


def stored_log(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the scan log with its sums: written once, read by every report."""
    from urlwarden.sources.telemetry_store import append_log

    def build(path: str) -> None:
        with scratch(spark):
            append_log(telemetry(spark, sf_dir), path)

    return shared(spark, f"log-{fingerprint_of(spark, f'{sf_dir}/events.parquet')}", build)


def ip_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address ranges (lo, hi, owner) that lie in and across each other, from nations and suppliers."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("owner"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("owner"))
    first = F.element_at(F.array(*[F.lit(int(p[:-1]) << 24).cast("long") for p in IP_PREFIXES]), (F.col("k") % 4 + 1).cast("int"))
    wide = n.select((first + F.col("k") * 3).alias("lo"), (first + F.col("k") * 3 + 60 - F.col("k")).alias("hi"), "owner")
    small = s.select((first + F.col("k") * 7 % 90).alias("lo"), (first + F.col("k") * 7 % 90 + F.col("k") % 11).alias("hi"), "owner")
    return wide.unionByName(small)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled payloads: document text features and the toxicity label as target."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("target"))
    return text_features(d.join(labels, "doc_id"), "text").drop("text")


PAYLOAD_FEATURES = ["n_chars", "shannon_entropy", "char_length", "digit_ratio",
                    "special_char_ratio", "uppercase_ratio"]
