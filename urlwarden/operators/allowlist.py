"""Allow-list decisions: exact domains, apex domains, trusted patterns, homograph guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from urlwarden import fixed_values as V
from urlwarden.functions.text import quoted, strip
from urlwarden.functions.urls import is_homograph, with_domain, with_url_parts

TRUSTED_PATTERN = "|".join(V.ALLOW_PATTERNS)


def domain_hash(domain: Column) -> Column:
    return F.sha2(F.lower(strip(domain)), 256)


def allow_table(spark: SparkSession, custom: DataFrame | None = None,
                base: list[str] = V.ALLOW_DOMAINS_V4) -> DataFrame:
    """Distinct allowed domains with their hashes: the base list and custom entries."""
    domains = spark.createDataFrame([(d,) for d in base], "domain string")
    if custom is not None:
        domains = domains.unionByName(custom.select("domain"))
    return domains.distinct().withColumn("domain_hash", domain_hash(F.col("domain")))


def add_domains(allow: DataFrame, new: DataFrame) -> DataFrame:
    """Allowed domains plus new ones: trimmed, lower-cased, no blanks and no homographs."""
    clean = new.select(F.lower(strip(F.col("domain"))).alias("domain"))
    clean = clean.where((F.col("domain") != "") & ~is_homograph(F.col("domain")))
    return allow.select("domain").unionByName(clean).distinct()


def allow_stats(allow: DataFrame) -> DataFrame:
    return allow.agg(F.count("*").alias("registered_domains"),
                     F.countDistinct(domain_hash(F.col("domain"))).alias("hash_lookups")
                     ).withColumn("wildcard_patterns", F.lit(len(V.ALLOW_PATTERNS)).cast("long"))


def pattern_match(domain: Column) -> Column:
    return F.rlike(domain, F.lit(TRUSTED_PATTERN))


def suffix_match(hosts: DataFrame, suffixes: DataFrame, host: str = "domain") -> DataFrame:
    """Add ``suffix``: the longest of suffixes (suffix) that is the host or the end of it behind a dot.

    Each distinct host meets the table by its own label suffixes, an equi-join, so the cost follows
    the labels and not the number of patterns. Hosts of all rows are told apart first; a null host,
    or one no suffix fits, gets null. Suffixes are compared lower-cased, with outer dots and blanks off.
    """
    clean = F.lower(F.regexp_replace("suffix", r"^[\s.]+|[\s.]+$", ""))
    table = suffixes.select(clean.alias("suffix")).where("suffix <> ''").distinct()
    labels = F.split(F.lower("_host"), r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    distinct = hosts.select(F.col(host).alias("_host")).where("_host IS NOT NULL").distinct()
    found = (distinct.select("_host", F.explode(ends).alias("suffix")).join(table, "suffix")
             .groupBy("_host").agg(F.max_by("suffix", F.length("suffix")).alias("suffix")))
    return hosts.join(found, hosts[host] == found["_host"], "left").drop("_host")


def _in_list(column: str, domains: list[str]) -> Column:
    return F.expr(f"{column} IN ({', '.join(map(quoted, domains))})")


def _listed(df: DataFrame, allow: DataFrame | None) -> DataFrame:
    """Add ``listed``: the domain or its apex is on the list.

    The base list is a constant and becomes a hash-set test in the scan. An allow table
    is joined twice; an OR in the join condition would become a nested loop. No hint:
    the planner broadcasts it where its measured size allows and splits hot hosts if not.
    """
    if allow is None:
        return df.withColumn("listed", _in_list("domain", V.ALLOW_DOMAINS_V4)
                             | _in_list("apex", V.ALLOW_DOMAINS_V4))
    keys = allow.select("domain").distinct()
    by_domain = keys.select(F.col("domain").alias("_d"))
    by_apex = keys.select(F.col("domain").alias("_a"))
    df = df.join(by_domain, df["domain"] == by_domain["_d"], "left")
    df = df.join(by_apex, df["apex"] == by_apex["_a"], "left")
    return df.withColumn("listed", F.col("_d").isNotNull() | F.col("_a").isNotNull()).drop("_d", "_a")


def allow_match(df: DataFrame, allow: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Add the parts of the decision (guarded, listed, trusted) and the decision (allowed)."""
    df = _listed(with_domain(df, strict), allow)
    df = df.withColumns({"guarded": is_homograph(F.col("domain")),
                         "trusted": pattern_match(F.col("domain"))})
    return df.withColumn("allowed", ~F.col("guarded") & (F.col("listed") | F.col("trusted")))


def allow_decision(df: DataFrame, allow: DataFrame | None = None, strict: bool = False,
                   url_col: str = "url") -> DataFrame:
    return allow_match(with_url_parts(df, url_col), allow, strict)


def allow_decision_v3(df: DataFrame, url_col: str = "url") -> DataFrame:
    """The v3 rule: own list, last two labels as apex, no guard, no patterns."""
    u = F.lower(strip(F.col(url_col)))
    web = F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://"))
    df = df.withColumn("_u", F.when(web, u).otherwise(F.concat(F.lit("http://"), u)))
    parts = with_url_parts(df, "_u").withColumn("domain", F.substring_index("netloc", ":", 1))
    apex = F.substring_index(F.col("domain"), ".", -2)
    return parts.withColumn("apex", apex).withColumn(
        "allowed", _in_list("domain", V.ALLOW_DOMAINS_V3) | _in_list("apex", V.ALLOW_DOMAINS_V3)
    ).drop("_u")
