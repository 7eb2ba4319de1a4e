"""Reports over the scan log: newest rows, lookup, statistics, counts, JSON rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERDICTS = ["MALICIOUS", "SAFE", "SUSPICIOUS"]
TIERS = [("Tier-3", "tier3_whitelist"), ("Tier-1", "tier1_redis_cache"), ("Tier-2", "tier2_nlp_ensemble")]


def recent(log: DataFrame, n: int = 50) -> DataFrame:
    """The newest rows by id; a top-n per task, then one of n rows per task."""
    return log.orderBy(F.col("id").desc()).limit(n)


def tier(source: Column) -> Column:
    return F.regexp_extract(source, r"(Tier-\d+)", 1)


def log_detail(log: DataFrame, log_id: int | None = None, recent_rows: int | None = None) -> DataFrame:
    """Rows with derived status columns, by id; ``recent_rows`` limits the search to the newest."""
    if recent_rows is not None:
        log = recent(log, recent_rows)
    if log_id is not None:
        log = log.where(F.col("id") == log_id)
    return log.withColumns({
        "http_status": F.when(F.col("verdict") == "SAFE", 200).otherwise(404),
        "playbook_status": F.when(F.col("verdict") == "MALICIOUS", "EXECUTED_AUTOMATED_BLOCK")
                            .otherwise("PASSED_PERIMETER"),
    })


def stats(log: DataFrame, recent_rows: int | None = None) -> DataFrame:
    """Totals, counts per verdict and tier and the mean latency; zeros for an empty log."""
    if recent_rows is not None:
        log = recent(log, recent_rows)
    per_verdict = [F.count_if(F.col("verdict") == v).alias(f"{v.lower()}_count") for v in VERDICTS]
    per_tier = [F.count_if(F.contains("source", F.lit(t))).alias(name) for t, name in TIERS]
    return log.agg(F.count("*").alias("total_scans"), *per_verdict,
                   F.round(F.coalesce(F.avg("latency"), F.lit(0.0)), 3).alias("avg_latency_ms"),
                   *per_tier)


def stats_of_sums(sums: DataFrame) -> DataFrame:
    """The result of ``stats`` from the stored sums of a log."""
    def count(when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")

    per_verdict = [count(F.col("verdict") == v).alias(f"{v.lower()}_count") for v in VERDICTS]
    per_tier = [count(F.contains("source", F.lit(t))).alias(name) for t, name in TIERS]
    mean = F.sum("latency") / F.sum("timed")
    return sums.agg(count(F.lit(True)).alias("total_scans"), *per_verdict,
                    F.round(F.coalesce(mean, F.lit(0.0)), 3).alias("avg_latency_ms"), *per_tier)


def verdict_counts_of_sums(sums: DataFrame) -> DataFrame:
    return sums.groupBy("verdict").agg(F.sum("n").alias("n"))


def tier_counts_of_sums(sums: DataFrame) -> DataFrame:
    return sums.groupBy(tier(F.col("source")).alias("tier")).agg(F.sum("n").alias("n"))


def stats_v3(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total_scans"),
                   F.count_if(F.col("verdict") == "MALICIOUS").alias("malicious_detected"),
                   F.round(F.coalesce(F.avg("latency"), F.lit(0.0)), 2).alias("avg_latency_ms"))


def verdict_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("verdict").agg(F.count("*").alias("n"))


def tier_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(tier(F.col("source")).alias("tier")).agg(F.count("*").alias("n"))


# Times keep their microseconds in JSON.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def log_json(log: DataFrame, columns: list[str]) -> DataFrame:
    return log.select("id", F.to_json(F.struct(*columns), JSON).alias("log_json"))


def read_log_json(rows: DataFrame, schema: T.StructType) -> DataFrame:
    return rows.select(F.from_json("log_json", schema, JSON).alias("r")).select("r.*")
