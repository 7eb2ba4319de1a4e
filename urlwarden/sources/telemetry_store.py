"""The scan log and the verdict table on disk.

A log is a folder of appends: ``rows/append=…`` has the rows of one, a folder per day, and
``sums/append=…`` its sums per day, verdict and source, written after the rows. Reports merge sums and
read no rows; the newest rows are found by the ids that the sums of a day tell.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlwarden.session import delete_folder

SCHEMA = (
    "id bigint, url string, verdict string, source string, risk_score double, latency double, "
    "timestamp timestamp, resolved_ip string, asn_owner string, http_status int, forensics struct<"
    "summary:string,mitre_ttps:array<struct<id:string,name:string>>,indicators:array<string>,"
    "playbook_actions:array<string>,entropy:string,brand_dist:string,subdomains:string,"
    "digit_ratio:string,dga_score:string,punycode:string,"
    "xai_attribution:array<struct<feature:string,contribution:string>>>, scan_date date"
)


def append_telemetry(rows: DataFrame, path: str) -> None:
    """Append scan rows, one folder per day.

    The rebalance hint gives each day a few full files: small days are merged and a day
    that holds most rows is split over many writers.
    """
    dated = rows.withColumn("scan_date", F.to_date("timestamp"))
    dated.hint("rebalance", "scan_date").write.mode("append").partitionBy("scan_date").parquet(path)


SUMS = ("scan_date date, verdict string, source string, n bigint, timed bigint, latency double, "
        "least bigint, most bigint")


def day_sums(rows: DataFrame) -> DataFrame:
    """Sums of log rows per day, verdict and source: rows, rows with a latency and its sum, ids."""
    return rows.groupBy("scan_date", "verdict", "source").agg(
        F.count("*").alias("n"), F.count("latency").alias("timed"), F.sum("latency").alias("latency"),
        F.min("id").alias("least"), F.max("id").alias("most"))


def append_log(rows: DataFrame, root: str) -> str:
    """Append scan rows and their sums; returns the name of the append.

    Rows count once they are whole. If the job ends before their sums are written, readers sum
    the rows themselves, and ``write_sums`` mends that.
    """
    name = f"append={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    append_telemetry(rows, f"{root}/rows/{name}")
    write_sums(rows.sparkSession, root, name)
    return name


def write_sums(spark: SparkSession, root: str, name: str) -> None:
    # One row per day, verdict and source of the append.
    day_sums(read_telemetry(spark, f"{root}/rows/{name}")).coalesce(1).write.mode("overwrite").parquet(f"{root}/sums/{name}")


def _complete(spark: SparkSession, root: str) -> list[str]:
    """Names of the finished writes below a folder."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(base))
    return [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """All rows of a log."""
    names = _complete(spark, f"{root}/rows")
    if not names:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).option("basePath", f"{root}/rows").parquet(*[f"{root}/rows/{n}" for n in names])
    return rows.drop("append")


def read_sums(spark: SparkSession, root: str) -> DataFrame:
    """The stored sums of a log; a day can have several rows for a verdict and source."""
    names = _complete(spark, f"{root}/rows")
    summed = set(_complete(spark, f"{root}/sums")) & set(names)
    parts = [spark.createDataFrame([], SUMS)]
    if summed:
        parts.append(spark.read.schema(SUMS).parquet(*[f"{root}/sums/{n}" for n in sorted(summed)]))
    parts += [day_sums(read_telemetry(spark, f"{root}/rows/{n}")) for n in names if n not in summed]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def newest(spark: SparkSession, root: str, n: int = 50) -> DataFrame:
    """The n rows with the highest ids. Sums tell an id that n rows reach at least and the days that
    hold such ids; other days are not opened, and smaller ids are skipped by the files' statistics."""
    days = read_sums(spark, root).groupBy("scan_date").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).collect()  # a row per day
    log, held = read_log(spark, root), 0
    for day in sorted((d for d in days if d["least"] is not None), key=lambda d: -d["least"]):
        held += day["n"]
        if held >= n:
            wanted = [d["scan_date"] for d in days if d["most"] is not None and d["most"] >= day["least"]]
            log = log.where(F.col("scan_date").isin(wanted) & (F.col("id") >= day["least"]))
            break
    return log.orderBy(F.col("id").desc()).limit(n)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_telemetry_v3(rows: DataFrame) -> DataFrame:
    """Older rows: ``latency_ms`` and an ISO text time."""
    return rows.withColumnRenamed("latency_ms", "latency").withColumn(
        "timestamp", F.to_timestamp("timestamp"))


def write_snapshot(entries: DataFrame, root: str, version: int) -> str:
    """Write the verdict table as a new version; readers take the newest complete one.

    The version before it stays for a batch that runs again; older ones are deleted.
    """
    path = f"{root}/v={version:012d}"
    entries.write.mode("overwrite").parquet(path)
    for old in _versions(entries.sparkSession, root):
        if old < version - 1:
            delete_folder(entries.sparkSession, f"{root}/v={old:012d}")
    return path


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions below a folder, newest first."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    return sorted((int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(base)), reverse=True)


def read_snapshot(spark: SparkSession, root: str, schema: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (below ``before``), or None."""
    for version in _versions(spark, root):
        path = f"{root}/v={version:012d}"
        done = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        if (before is None or version < before) and done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            return spark.read.schema(schema).parquet(path)
    return None
