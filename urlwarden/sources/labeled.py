"""Labelled URL tables: CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELED = "url string, label int"
PAYLOAD = "raw_payload string, feature_val_1 double, feature_val_2 double, feature_val_3 double, target int"

# Values keep their blanks; quotes inside a value are doubled, as common CSV readers expect.
CSV = {"header": "true", "quote": '"', "escape": '"',
       "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_labeled_urls(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**CSV).schema(LABELED).csv(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(**CSV, multiLine="true").schema(PAYLOAD).csv(path)


def write_labeled_urls(df: DataFrame, path: str) -> None:
    df.select("url", F.col("label").cast("int")).write.options(**CSV).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")) or fs.isFile(jvm_path)


def load_or_build(spark: SparkSession, path: str, benign: DataFrame, phishing: DataFrame) -> DataFrame:
    """Read the labelled CSV; build it from a benign and a phishing list if it is missing."""
    if not _exists(spark, path):
        rows = benign.select("url", F.lit(0).alias("label")).unionByName(
            phishing.select("url", F.lit(1).alias("label")))
        write_labeled_urls(rows, path)
    return read_labeled_urls(spark, path)
