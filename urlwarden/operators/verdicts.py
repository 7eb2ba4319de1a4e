"""The verdict cache as a table: write, upsert, purge, expire, as-of lookup, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlwarden import fixed_values as V
from urlwarden.functions.risk import ttl_seconds
from urlwarden.functions.urls import url_hash
from urlwarden.session import materialise

ENTRY = ["url_hash", "url", "verdict", "risk_score", "cached_at", "expires_at"]


def plus_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + seconds.cast("long") * 1000000)


def new_entries(scored: DataFrame, cached_at: Column, prefix: str = "") -> DataFrame:
    """Entries for scored URLs; the lifetime follows the verdict."""
    df = scored.withColumn("cached_at", cached_at)
    return df.select(
        url_hash(F.col("url"), prefix).alias("url_hash"), "url", "verdict", "risk_score",
        "cached_at",
        plus_seconds(F.col("cached_at"), ttl_seconds(F.col("verdict"))).alias("expires_at"))


def upsert_verdicts(current: DataFrame, new: DataFrame) -> DataFrame:
    """The newest entry per key. Partial aggregation keeps one entry per key and task."""
    rows = current.select(*ENTRY).unionByName(new.select(*ENTRY))
    newest = F.max_by(F.struct(*ENTRY[1:]), F.struct("cached_at", "expires_at", "url"))
    return rows.groupBy("url_hash").agg(newest.alias("e")).select("url_hash", "e.*")


def purge_verdicts(current: DataFrame, urls: DataFrame | None = None, prefix: str = "") -> DataFrame:
    """Drop the entries of the given URLs, or all entries without a list."""
    if urls is None:
        return current.limit(0)
    gone = urls.select(url_hash(F.col("url"), prefix).alias("url_hash")).distinct()
    return current.join(gone, "url_hash", "left_anti")


def expire_verdicts(current: DataFrame, now: Column) -> DataFrame:
    return current.where(F.col("expires_at") >= now)


def lookup_verdicts(scans: DataFrame, entries: DataFrame, prefix: str = "") -> DataFrame:
    """As-of lookup: the newest entry written up to the scan time, if it is still alive.

    Scans and entries are one table, dealt by ranges of (key, time): a hot key fills as many
    ranges as it needs, cut over time. In a range the newest entry is carried forward over the
    sorted rows. What a range needs from those before it is one entry per key, a partial
    maximum. So no scan is paired with an entry, and the work is linear in both tables.
    """
    spark = scans.sparkSession
    keyed = scans.withColumn("url_hash", url_hash(F.col("url"), prefix))
    entry = F.struct("verdict", "risk_score", "expires_at")
    written = entries.groupBy("url_hash", F.col("cached_at").alias("_at")).agg(
        F.max_by(entry, F.struct("expires_at", "url")).alias("_entry"))
    # Entries come before scans of their time; the tie spreads scans of one key and moment.
    rows = keyed.select(
        "url_hash", F.col("ts").alias("_at"), F.lit(1).alias("_kind"), F.xxhash64(*scans.columns).alias("_tie"),
        F.struct(*keyed.columns).alias("_scan")).unionByName(
        written.select("url_hash", "_at", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"), "_entry"),
        allowMissingColumns=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once, so the ranges stay what they are for both uses.
    dealt = materialise(rows.repartitionByRange(n, "url_hash", "_at", "_kind", "_tie").withColumn(
        "_range", F.spark_partition_id()), "asof")
    newest = dealt.groupBy("url_hash", "_range").agg(
        F.max(F.when(F.col("_kind") == 0, F.struct("_at", "_entry"))).alias("_last"))
    before = Window.partitionBy("url_hash").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    seeds = newest.withColumn("_last", F.last("_last", ignorenulls=True).over(before)).where(
        F.col("_last").isNotNull()).select("url_hash", "_range", F.col("_last._at").alias("_at"),
                                           F.lit(0).alias("_kind"), F.col("_last._entry").alias("_entry"))
    upto = Window.partitionBy("url_hash", "_range").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = dealt.unionByName(seeds, allowMissingColumns=True).withColumn(
        "_entry", F.last("_entry", ignorenulls=True).over(upto)).where(F.col("_kind") == 1)
    alive = F.col("_entry.expires_at") >= F.col("_at")
    return carried.select(
        "_scan.*", F.when(alive, F.col("_entry.verdict")).alias("cached_verdict"),
        F.when(alive, F.col("_entry.risk_score")).alias("cached_risk"),
        F.when(alive, 1).otherwise(0).alias("hit"))


def cache_stats(looked_up: DataFrame, entries: DataFrame) -> DataFrame:
    """Hits, misses, hit ratio in percent and the number of keys."""
    hits = looked_up.agg(F.sum("hit").alias("hits"), F.count("*").alias("total"))
    keys = entries.agg(F.countDistinct("url_hash").alias("keys"))
    both = hits.unionByName(keys, allowMissingColumns=True).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("hits", "total", "keys")])
    ratio = F.when(F.col("total") > 0, F.round(F.col("hits") * 100 / F.col("total"), 2)).otherwise(0.0)
    return both.select("hits", (F.col("total") - F.col("hits")).alias("misses"),
                       ratio.alias("hit_ratio_percent"), "keys")


def first_seen(scans: DataFrame, order_col: str = "scan_id") -> DataFrame:
    """Mark the first scan of each URL in a batch; later ones count as cache hits.

    The first id per key is a partial aggregate, and the mark is joined back on the unique
    id, so a hot URL never gathers in one task.
    """
    s = scans.withColumn("url_hash", url_hash(F.col("url")))
    firsts = s.groupBy("url_hash").agg(F.min(order_col).alias(order_col)).select(
        order_col, F.lit(1).alias("is_first"))
    out = s.join(firsts, order_col, "left")
    return out.withColumn("is_first", F.coalesce("is_first", F.lit(0)))
