"""Network columns from a passive-DNS table: address and network owner per scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlwarden import fixed_values as V
from urlwarden.functions.text import strip
from urlwarden.functions.urls import network_host


def asn_owner(ip: Column, dialect: str = "api") -> Column:
    out = None
    for prefixes, owner in V.ASN_BY_PREFIX:
        hit = F.startswith(ip, F.lit(prefixes[0]))
        for p in prefixes[1:]:
            hit = hit | F.startswith(ip, F.lit(p))
        out = F.when(hit, owner) if out is None else out.when(hit, owner)
    return out.otherwise(F.format_string(V.NETWORK_TEXTS[dialect]["resolved"], ip))


def enrich_network(df: DataFrame, dns: DataFrame, url_col: str = "url",
                   dialect: str = "api") -> DataFrame:
    """Left join to the DNS table (host, ip); unknown hosts get the unresolvable texts."""
    texts = V.NETWORK_TEXTS[dialect]
    d = dns.select(F.lower("host").alias("_dns_host"), F.col("ip").alias("_ip"))
    df = df.withColumn("_host", F.lower(network_host(strip(F.col(url_col)))))
    joined = df.join(d, df["_host"] == d["_dns_host"], "left")
    known = F.col("_ip").isNotNull()
    return joined.withColumns({
        "resolved_ip": F.when(known, F.col("_ip")).otherwise(texts["no_ip"]),
        "asn_owner": F.when(known, asn_owner(F.col("_ip"), dialect)).otherwise(texts["no_asn"]),
    }).drop("_host", "_dns_host", "_ip")


def default_network(df: DataFrame) -> DataFrame:
    """The older storage defaults: missing columns are filled by verdict."""
    bad = F.col("verdict") == "MALICIOUS"
    mal, other = V.NETWORK_BY_VERDICT["MALICIOUS"], V.NETWORK_BY_VERDICT["OTHER"]
    return df.withColumns({
        "resolved_ip": F.coalesce(F.col("resolved_ip"), F.when(bad, mal[0]).otherwise(other[0])),
        "asn_owner": F.coalesce(F.col("asn_owner"), F.when(bad, mal[1]).otherwise(other[1])),
    })
