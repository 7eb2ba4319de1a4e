"""WARC archives of web pages, and a Merkle audit of their replicas.

An archive is a folder of gzip WARC files, one per shard of at most `shard_pages` pages. A shard's
tree has the SHA-256 of each record as leaves, in the order of their offsets; a node above stands
for a range of offsets and hashes its children's digests. Above the shards the tree goes on over
ranges of shard numbers up to one root. An audit compares the roots of two replicas and goes down
only below nodes that differ, so an intact replica costs one comparison.
"""

from __future__ import annotations

import gzip
import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlwarden.session import materialise, workspace

MAGIC = b"WARC/1.0\r\n"
FANOUT_BITS = 4  # in a shard
SHARD_BITS = 8  # above the shards
ROOM = 1 << 21  # shards per partition in the shard number


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A page as a WARC resource record without the two line ends that close it. A null url is left
    out, line ends in it are escaped, and a null html is an empty payload."""
    payload = F.coalesce(html.cast("string"), F.lit(""))
    target = F.regexp_replace(F.regexp_replace(url.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), target, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload)


def _write(rows: DataFrame, path: str) -> None:
    """rows (shard, pos, value), each shard in one partition."""
    (rows.sortWithinPartitions("shard", "pos").select("shard", "value").write.partitionBy("shard")
     .option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path))


def write_archive(pages: DataFrame, path: str, shard_pages: int = 4096) -> None:
    """Write pages (page_id, url, html, any others) below path in ascending page_id order.

    Pages without page_id come first; repeated ids follow each other by a hash of url and html, so
    one id with any number of rows fills as many shards as it needs. No pages give no file.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.xxhash64("url", "html").alias("tie"),
                        record(F.col("page_id"), F.col("url"), F.col("html")).alias("value"))
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "page_id", "tie").sortWithinPartitions("page_id", "tie")
    place = F.monotonically_increasing_id()
    part, row = F.shiftright(F.col("at"), 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = ordered.withColumn("at", place).select(
        (part * ROOM + F.floor(row / shard_pages)).alias("shard"), row.alias("pos"), "value")
    _write(placed, path)


def split_records(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each record with its closing line ends. Where a length is damaged, the
    record ends before the next one's first line, or with the file."""
    found, at = [], 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        size = re.search(rb"\r\nContent-Length: (\d{1,18})\r\n", data[at : head + 2]) if head >= 0 else None
        end = head + 8 + int(size[1]) if size else -1
        if end < 0 or data[end - 4 : end] != b"\r\n\r\n" or end < len(data) and not data.startswith(MAGIC, end):
            after = data.find(b"\r\n\r\n" + MAGIC, at + 1)
            end = after + 4 if after >= 0 else len(data)
        found.append((at, end))
        at = end
    return found


def shard_tree(data: bytes) -> list[tuple[int, int, int, int, str, str | None]]:
    """(level, idx, start, end, digest, record id) of each node of a shard, from the leaves up."""
    rows = []
    level, nodes = 0, []
    for start, end in split_records(data):
        name = re.search(rb"\r\nWARC-Record-ID: <([^>\r\n]*)>", data[start : min(end, start + 4096)])
        nodes.append((start, end, hashlib.sha256(data[start:end]).hexdigest(), name[1].decode("utf-8", "replace") if name else None))
    while nodes:
        rows += [(level, i, *node) for i, node in enumerate(nodes)]
        if len(nodes) == 1:
            break
        step = 1 << FANOUT_BITS
        groups = [nodes[i : i + step] for i in range(0, len(nodes), step)]
        nodes = [(g[0][0], g[-1][1], hashlib.sha256("".join(x[2] for x in g).encode()).hexdigest(), None) for g in groups]
        level += 1
    return rows


FINDINGS = "shard long, idx long, record string, first long, last long, kind string, expected string, found string"
NODES = "shard long, level int, idx long, first long, last long, digest string, record string"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content) of each file below path; a folder without files gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", "shard=([0-9]+)", 1).cast("long").alias("shard"), "content")


def archive_tree(spark: SparkSession, path: str) -> tuple[DataFrame, list[DataFrame]]:
    """(nodes inside shards, levels above them). A level is (idx, digest); the first has the shards'
    roots, the last the archive's."""

    def run(frames):
        for pdf in frames:
            rows = [(shard, *node) for shard, content in zip(pdf["shard"], pdf["content"])
                    for node in shard_tree(gzip.decompress(content))]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in NODES.split(", ")])

    nodes = materialise(_files(spark, path).mapInPandas(run, NODES), "tree")
    top = nodes.groupBy("shard").agg(F.max_by("digest", "level").alias("digest"))
    levels = [materialise(top.select(F.col("shard").alias("idx"), "digest"), "level")]
    while levels[-1].limit(2).count() > 1:
        children = F.sort_array(F.collect_list(F.struct("idx", "digest")))
        above = levels[-1].groupBy(F.shiftright("idx", SHARD_BITS).alias("parent")).agg(children.alias("c"))
        digest = F.sha2(F.concat_ws("", F.transform("c", lambda c: F.concat(c["idx"].cast("string"), c["digest"]))), 256)
        levels.append(materialise(above.select(F.col("parent").alias("idx"), digest.alias("digest")), "level"))
    return nodes, levels


def _differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return (a.select(*keys, F.col("digest").alias("expected")).join(b.select(*keys, F.col("digest").alias("found")), keys, "full")
            .where(~F.col("expected").eqNullSafe(F.col("found"))))


def audit(spark: SparkSession, original: str, replica: str) -> DataFrame:
    """One row for each record of the original that the replica has not byte for byte in its place,
    and for each one it has beyond: shard, idx, record, first, last, kind, expected, found.

    first and last are the record's range of bytes in the uncompressed shard; kind is damaged,
    missing or extra. Equal replicas give no rows, and nothing below their roots is read. In a shard
    that lost or gained whole records, those after the gap are out of place and told as damaged.
    """
    (a, tops_a), (b, tops_b) = archive_tree(spark, original), archive_tree(spark, replica)
    while len(tops_a) < len(tops_b):
        tops_a.append(_raised(tops_a[-1]))
    while len(tops_b) < len(tops_a):
        tops_b.append(_raised(tops_b[-1]))
    wrong = materialise(_differing(tops_a[-1], tops_b[-1], ["idx"]).select("idx"), "wrong")
    for x, y in zip(reversed(tops_a[:-1]), reversed(tops_b[:-1])):
        under = wrong.withColumnRenamed("idx", "parent")
        x, y = (t.withColumn("parent", F.shiftright("idx", SHARD_BITS)).join(under, "parent", "left_semi") for t in (x, y))
        wrong = materialise(_differing(x, y, ["idx"]).select("idx"), "wrong")
    wrong = wrong.withColumnRenamed("idx", "shard")
    if wrong.limit(1).count() == 0:
        return spark.createDataFrame([], FINDINGS)
    heights = materialise(a.union(b).join(wrong, "shard", "left_semi").groupBy("shard").agg(F.max("level").alias("height")), "heights")
    under = None  # ranges of the level above that differ; a shard joins in at its root's level
    for level in range(heights.agg(F.max("height")).first()[0], -1, -1):
        roots = heights.where(F.col("height") == level).select("shard", F.lit(0).cast("long").alias("parent"))
        under = roots if under is None else under.union(roots)
        x, y = (t.where(F.col("level") == level).withColumn("parent", F.shiftright("idx", FANOUT_BITS))
                .join(under, ["shard", "parent"], "left_semi") for t in (a, b))
        differ = materialise(_differing(x, y, ["shard", "idx"]), "differ")
        under = differ.select("shard", F.col("idx").alias("parent"))
    leaf = lambda t, tag: t.where("level = 0").select("shard", "idx", *[F.col(c).alias(f"{c}_{tag}") for c in ("first", "last", "record")])
    kind = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("damaged")
    both = differ.join(leaf(a, "a"), ["shard", "idx"], "left").join(leaf(b, "b"), ["shard", "idx"], "left")
    pick = lambda c: F.coalesce(f"{c}_a", f"{c}_b").alias(c)
    return both.select("shard", "idx", pick("record"), pick("first"), pick("last"), kind.alias("kind"), "expected", "found")


def _raised(level: DataFrame) -> DataFrame:
    """The level above a root that stands alone."""
    return level.select(F.shiftright("idx", SHARD_BITS).alias("idx"), "digest")


def copy_archive(spark: SparkSession, source: str, target: str, damage=None) -> None:
    """Copy an archive record by record. damage(record id, record text) may return another text, or
    None to lose the record: a drill for the audit. A record without an id has the id ''. An archive
    without files gives a copy without files, and so does one that loses all records."""

    def run(frames):
        for pdf in frames:
            for shard, content in zip(pdf["shard"], pdf["content"]):
                data, values = gzip.decompress(content), []
                for start, end in split_records(data):
                    text = data[start : end - 4].decode("utf-8", "replace")
                    if damage:
                        name = re.search(r"WARC-Record-ID: <([^>\r\n]*)>", text)
                        text = damage(name[1] if name else "", text)
                    if text is not None:
                        values.append(text)
                if values:
                    yield pd.DataFrame({"shard": shard, "pos": range(len(values)), "value": values})

    _write(_files(spark, source).mapInPandas(run, "shard long, pos long, value string"), target)


def drill(pages: DataFrame, damage, shard_pages: int = 4096) -> DataFrame:
    """Archive the pages, copy the archive with damage, and audit the copy. No pages, no rows."""
    spark = pages.sparkSession
    original, replica = workspace(spark, "warc"), workspace(spark, "warc")
    write_archive(pages, original, shard_pages)
    copy_archive(spark, original, replica, damage)
    return audit(spark, original, replica)
