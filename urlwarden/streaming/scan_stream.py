"""Streaming scans: the cascade on every micro-batch, telemetry rows out."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from urlwarden.functions.risk import ttl_seconds
from urlwarden.functions.text import strip
from urlwarden.functions.urls import with_url_hash
from urlwarden.plans.scan import resolve_tiers, scored_requests, with_reject_reason
from urlwarden.streaming.ttl_stream import replay_stream, run_batches

RESULT = ["scan_id", "ts", "url", "latency", "verdict", "source", "risk_score", "forensics"]


def marked_requests(source: DataFrame, allow: DataFrame | None = None, delay: str = "0 seconds") -> DataFrame:
    """Requests (scan_id, ts, url, …) with ``hit``, and the ``reason`` of those that cannot be scanned.

    Only scans the allow-list does not know reach the cache state. The verdict depends on the URL
    alone, so a hit carries the verdict the scorer gives.
    """
    columns = source.columns
    told = with_reject_reason(source)
    scored = with_url_hash(scored_requests(told.where("reason IS NULL").drop("reason"), allow))
    scored = scored.select(*columns, "allowed", "url_hash", ttl_seconds(F.col("verdict")).alias("ttl"))
    asked = replay_stream(scored.where(~F.col("allowed")).drop("allowed"), delay=delay)
    none = F.lit(None).cast("string").alias("reason")
    return (asked.select(*columns, "hit", none)
            .unionByName(scored.where("allowed").select(*columns, F.lit(0).alias("hit"), none))
            .unionByName(told.where("reason IS NOT NULL").select(*columns, F.lit(0).alias("hit"), "reason")))


def results_of(marked: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """Telemetry rows of marked requests."""
    done = resolve_tiers(scored_requests(marked.drop("reason"), allow).withColumns({
        "cached_verdict": F.col("verdict"), "cached_risk": F.col("risk_score")}))
    return done.withColumn("url", strip(F.col("url"))).select(*RESULT)


def start_scan_stream(source: DataFrame, root: str, trigger: dict | None = None,
                      allow: DataFrame | None = None, delay: str = "0 seconds") -> StreamingQuery:
    """Scan a stream of requests (scan_id, ts, url, latency). Telemetry rows land below
    ``root/telemetry``, requests that cannot be scanned below ``root/invalid``.

    Scans that come later than ``delay`` get their verdict too; they only read the cache.
    """
    columns = source.columns

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.DISK_ONLY)  # both writes take one run over the state
        results_of(batch.where("reason IS NULL"), allow).write.mode("overwrite").parquet(f"{root}/telemetry/batch={batch_id}")
        batch.where("reason IS NOT NULL").select(*columns, "reason").write.mode("overwrite").parquet(
            f"{root}/invalid/batch={batch_id}")
        batch.unpersist()

    return run_batches(marked_requests(source, allow, delay), root, each, trigger)
