"""Canonical URLs, hashes and URL parts.

Hosts with underscores or non-ASCII letters matter here and ``parse_url`` rejects
them, so the parts are cut with regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlwarden import fixed_values as V
from urlwarden.functions.text import literals, strip


PARTS = ("canonical", "scheme", "netloc", "path", "query", "host")


def canonical(url: Column) -> Column:
    return F.lower(strip(url))


def url_hash(url: Column, prefix: str = "") -> Column:
    digest = F.sha2(canonical(url), 256)
    return F.concat(F.lit(prefix), digest) if prefix else digest


def with_url_hash(df: DataFrame, url_col: str = "url", prefix: str = "") -> DataFrame:
    return df.withColumn("url_hash", url_hash(F.col(url_col), prefix))


def with_url_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add canonical, scheme, netloc, path, query and host (netloc, else first path segment).

    The parts leave as one inlined struct: filters on them or on what is built from them stop
    there instead of being pushed down as copies of the whole chain of expressions.
    """
    keep = df.columns
    df = df.withColumn("canonical", canonical(F.col(url_col)))
    u = F.col("canonical")
    full = F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("http://"), u))
    df = df.withColumn("_full", F.translate(full, "\t\r\n", ""))
    df = df.withColumn("scheme", F.regexp_extract("_full", r"^([a-z][a-z0-9+.\-]*):", 1))
    rest = F.when(F.col("scheme") == "", F.col("_full")).otherwise(
        F.substring(F.col("_full"), F.length("scheme") + 2, F.length("_full")))
    df = df.withColumn("_rest", rest)
    df = df.withColumns({
        "netloc": F.regexp_extract("_rest", r"^//([^/?#]*)", 1),
        "query": F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1),
    })
    after = F.when(
        F.startswith(F.col("_rest"), F.lit("//")),
        F.substring(F.col("_rest"), F.length("netloc") + 3, F.length("_rest")),
    ).otherwise(F.col("_rest"))
    raw_path = F.regexp_extract(after, r"^([^?#]*)", 1)
    df = df.withColumn("path", F.when(
        F.array_contains(literals(V.PARAM_SCHEMES), F.col("scheme")) & F.contains(raw_path, F.lit(";")),
        F.regexp_replace(raw_path, r";[^/]*$", "")).otherwise(raw_path))
    host = F.when(F.col("netloc") != "", F.col("netloc")).otherwise(F.substring_index("path", "/", 1))
    parts = F.struct("canonical", "scheme", "netloc", "path", "query", host.alias("host"))
    return df.select(*[c for c in keep if c not in PARTS], F.inline(F.array(parts)))


def first_label(host: Column) -> Column:
    return F.substring_index(host, ".", 1)


def allow_domain(netloc: Column, strict: bool = False) -> Column:
    """Host without port and one leading ``www.``; ``strict`` also drops userinfo."""
    if strict:
        netloc = F.substring_index(netloc, "@", -1)
    return F.regexp_replace(F.substring_index(netloc, ":", 1), r"^www\.", "")


def apex_domain(domain: Column) -> Column:
    """Last two labels, or three below a two-part country suffix."""
    labels = F.split(domain, r"\.")
    n = F.size(labels)
    two_part = (F.array_contains(literals(V.SECOND_LEVEL_LABELS), F.try_element_at(labels, F.lit(-2)))
                & (F.length(F.try_element_at(labels, F.lit(-1))) == 2))
    return (F.when(n < 3, domain)
            .when(two_part, F.substring_index(domain, ".", -3))
            .otherwise(F.substring_index(domain, ".", -2)))


def with_domain(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add domain and apex; needs the columns of ``with_url_parts``."""
    df = df.withColumn("domain", allow_domain(F.col("netloc"), strict))
    return df.withColumn("apex", apex_domain(F.col("domain")))


def network_host(url: Column) -> Column:
    """Host for network lookups: after the last ``://``, up to ``/`` and ``:``."""
    tail = F.substring_index(url, "://", -1)
    return F.substring_index(F.substring_index(tail, "/", 1), ":", 1)


def is_homograph(text: Column) -> Column:
    return F.contains(text, F.lit("xn--")) | F.rlike(text, F.lit(r"[^\x00-\x7F]"))
