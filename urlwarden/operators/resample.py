"""Class balancing: SMOTE, SMOTE with Tomek cleaning, ADASYN, class counts.

Rows are (id, vec, label) with labels 0 and 1. Random choices are hashes of the row id, the
copy number and the seed, so a repeated or retried run gives the same rows. Neighbours are exact;
``search=approx_neighbours.lsh_knn`` finds them by random-projection trees instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlwarden.operators.neighbours import knn, tomek_links
from urlwarden.operators.split import pick_exactly
from urlwarden.session import materialise

NEIGHBOURS = 5
Search = Callable[[DataFrame, int], DataFrame]


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def _counts(df: DataFrame) -> tuple[int, int, int]:
    """Minority label, its rows, rows of the other class."""
    rows = {r["label"]: r["n"] for r in class_counts(df).collect()}
    minority = min(rows, key=lambda c: (rows[c], c))
    return minority, rows[minority], max(n for c, n in rows.items() if c != minority)


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def _grow(minority: DataFrame, quota: DataFrame, label: int, seed: int, k: int, search: Search) -> DataFrame:
    """New rows on the way from a minority row to one of its minority neighbours.

    ``quota`` (id, new) says how many rows grow from each row.
    """
    near = search(minority.select("id", "vec"), k)
    lists = near.groupBy("id").agg(  # k entries per row
        F.sort_array(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))
    seeds = minority.join(quota.where(F.col("new") > 0), "id").join(lists, "id")
    seeds = seeds.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("new").cast("int"))))
    choice = F.pmod(F.xxhash64("id", "i", F.lit(seed)), F.size("near")) + 1
    seeds = seeds.select("id", "vec", "i", F.element_at("near", choice.cast("int"))["neighbour"].alias("other"),
                         _uniform(F.col("id"), F.col("i"), F.lit(seed + 1)).alias("gap"))
    ends = minority.select(F.col("id").alias("other"), F.col("vec").alias("end"))
    grown = seeds.join(ends, "other")
    vec = F.zip_with("vec", "end", lambda a, b: a + F.col("gap") * (b - a))
    return grown.select((-F.xxhash64("id", "i", F.lit(seed)).bitwiseAND((1 << 62) - 1) - 1).alias("id"),
                        vec.alias("vec"), F.lit(label).alias("label"))


def smote(df: DataFrame, seed: int = 42, k: int = NEIGHBOURS, search: Search = knn) -> DataFrame:
    """Grow the minority class to the size of the other one."""
    df = materialise(df.select("id", "vec", F.col("label").cast("int").alias("label")), "smote-in")
    label, n_min, n_maj = _counts(df)
    minority = df.where(F.col("label") == label)
    each, extra = divmod(n_maj - n_min, n_min)
    quota = pick_exactly(minority.select("id"), "id", extra, seed).select(
        "id", (F.lit(each) + F.col("picked").cast("int")).alias("new"))
    return df.unionByName(_grow(minority, quota, label, seed, min(k, n_min - 1), search))


def smote_tomek(df: DataFrame, seed: int = 42, k: int = NEIGHBOURS, search: Search = knn) -> DataFrame:
    """SMOTE, then both rows of every Tomek link are removed."""
    grown = materialise(smote(df, seed, k, search), "smote-out")
    links = tomek_links(grown)
    gone = links.select(F.explode(F.array("id", "other")).alias("id"))
    return grown.join(gone, "id", "left_anti")


def adasyn(df: DataFrame, seed: int = 42, k: int = NEIGHBOURS, search: Search = knn) -> DataFrame:
    """Grow the minority class where most of its neighbours belong to the other class."""
    df = materialise(df.select("id", "vec", F.col("label").cast("int").alias("label")), "adasyn-in")
    label, n_min, n_maj = _counts(df)
    minority = df.where(F.col("label") == label)
    near = search(df.select("id", "vec", (F.col("label") == label).alias("is_query")), k)
    labels = df.select(F.col("id").alias("neighbour"), "label")
    shares = materialise(near.join(labels, "neighbour").groupBy("id").agg(
        F.avg((F.col("label") != label).cast("double")).alias("share")), "adasyn-shares")
    total = shares.agg(F.sum("share")).first()[0]
    if not total:
        raise ValueError("no minority row has neighbours of the other class")
    quota = shares.select("id", F.rint(F.col("share") / total * (n_maj - n_min)).alias("new"))
    return df.unionByName(_grow(minority, quota, label, seed, min(k, n_min - 1), search))
