"""Live statistics: scans and mean latency per verdict and hour, updated with every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def window_stats(scans: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Windowed aggregate over (ts, verdict, latency); windows close ``late`` behind the newest row."""
    return (scans.withWatermark("ts", late)
            .groupBy(F.window("ts", width).alias("w"), "verdict")
            .agg(F.count("*").alias("n"), F.avg("latency").alias("avg_latency"))
            .select(F.col("w.start").alias("window_start"), "verdict", "n", "avg_latency"))


def start_stats_stream(scans: DataFrame, root: str, trigger: dict | None = None,
                       width: str = "1 hour", late: str = "10 minutes") -> StreamingQuery:
    """Write the windows each batch changed to the folder of the batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    return (window_stats(scans, width, late).writeStream.outputMode("update").foreachBatch(each)
            .option("checkpointLocation", f"{root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True})).start())


def latest_stats(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of every window: what a dashboard shows."""
    schema = "window_start timestamp, verdict string, n bigint, avg_latency double, batch bigint"
    rows = spark.read.schema(schema).parquet(f"{root}/out")
    newest = F.max_by(F.struct("n", "avg_latency"), "batch").alias("s")
    return rows.groupBy("window_start", "verdict").agg(newest).select("window_start", "verdict", "s.*")
