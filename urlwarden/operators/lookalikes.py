"""Brand look-alikes and lure frequencies over a corpus of URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlwarden.functions.lexical import PROFILES, url_features
from urlwarden.functions.text import unnest


def brand_lookalikes(urls: DataFrame, brands: list[str] = PROFILES["v4"].brands,
                     max_dist: int = 3) -> DataFrame:
    """Host labels within 1..max_dist edits of a brand, with their URL counts.

    Labels are counted first, so each distinct label meets the brands once and a hot label
    is one row. The brand list is a bounded constant in the plan; a distance that exceeds the
    threshold is cut off early, and brands of a far length are skipped.
    """
    df = url_features(urls)
    labels = df.groupBy(F.col("_label").alias("label")).agg(F.count("*").alias("n_urls"))
    n = F.length("label")
    near = [F.struct(F.levenshtein(F.col("label"), F.lit(b), max_dist).alias("distance"),
                     F.lit(i).alias("pos"), F.lit(b).alias("brand")) for i, b in enumerate(brands)]
    near = [F.when(F.abs(n - len(b)) <= max_dist, s) for s, b in zip(near, brands)]
    hits = unnest(labels, ["label", "n_urls"], F.array_compact(F.array(*near)), "h")
    # A distance beyond the threshold comes back as -1. The first brand of the list wins a tie.
    return (hits.where(F.col("h.distance") >= 0).groupBy("label", "n_urls")
            .agg(F.min(F.struct("h.distance", "h.pos", "h.brand")).alias("best"))
            .where(F.col("best.distance") >= 1)
            .select("label", "best.brand", "best.distance", "n_urls"))


def brand_table_lookalikes(urls: DataFrame, brands: DataFrame, max_dist: int = 3) -> DataFrame:
    """Host labels within 1..max_dist edits of a brand in a table (brand) of any length.

    A brand is cut into max_dist + 1 pieces. Within max_dist edits one piece stays whole and moves
    by max_dist places at most, so labels and brands meet on (brand length, piece number, piece):
    an equi-join, checked by the distance itself. Brands too short to be cut meet the labels short
    enough for them. Null and empty brands are left out; of equally near ones the first by name wins.
    """
    d = max_dist
    names = brands.select(F.lower(F.trim("brand")).alias("brand")).where("brand != ''").distinct()
    start, size = f"(i * (n div {d + 1}) + least(i, n % {d + 1}))", f"(n div {d + 1} + if(i < n % {d + 1}, 1, 0))"
    key = "concat_ws('|', n, i, substr({}, {} + 1, {}))"
    own = F.expr(f"if(n > {d}, transform(sequence(0, {d}), i -> {key.format('brand', start, size)}), array(concat('short|', n)))")
    brand_keys = names.withColumn("n", F.length("brand")).select("brand", F.explode(own).alias("key"))
    labels = url_features(urls).groupBy(F.col("_label").alias("label")).agg(F.count("*").alias("n_urls")).where("label != ''")
    moved = f"filter(sequence(-{d}, {d}), s -> {start} + s >= 0 AND {start} + s + {size} <= m)"
    long = (f"flatten(transform(sequence(greatest({d + 1}, m - {d}), m + {d}), n -> flatten(transform(sequence(0, {d}), i -> "
            f"transform({moved}, s -> {key.format('label', f'{start} + s', size)})))))")
    short = f"transform(filter(sequence(1, {d}), n -> m - n <= {d}), n -> concat('short|', n))"
    label_keys = labels.withColumn("m", F.length("label")).select(
        "label", "n_urls", F.explode(F.array_distinct(F.expr(f"concat({long}, {short})"))).alias("key"))
    pairs = label_keys.join(brand_keys, "key").select("label", "n_urls", "brand").distinct()
    near = pairs.withColumn("distance", F.levenshtein("label", "brand", d)).where("distance >= 0")
    return (near.groupBy("label", "n_urls").agg(F.min(F.struct("distance", "brand")).alias("best"))
            .where("best.distance >= 1").select("label", "best.brand", "best.distance", "n_urls"))


def lure_counts(urls: DataFrame) -> DataFrame:
    """URLs per lure keyword."""
    hits = unnest(url_features(urls), [], "lure_matches", "m")
    return hits.groupBy("m.category", "m.keyword").agg(F.count("*").alias("n"))
