"""Custom allow-lists as text files: one domain per line, blank lines and # comments skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urlwarden.functions.text import strip


def read_allow_text(spark: SparkSession, path: str) -> DataFrame:
    entry = F.lower(strip(F.col("value")))
    lines = spark.read.text(path).select(entry.alias("domain"))
    return lines.where((F.col("domain") != "") & ~F.startswith("domain", F.lit("#"))).distinct()
