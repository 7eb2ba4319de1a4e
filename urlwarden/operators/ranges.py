"""Addresses looked up in a table of ranges, as an equi-join on aligned prefixes.

A range is cut into aligned blocks of 2^k addresses, two of each size at most. A distinct address
meets the blocks of its prefixes, one for each size that occurs, so no pair is formed that does
not match. Of the ranges an address lies in, the narrowest wins: the longest match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    valid = ip.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?!$)|$)){4}$")
    number = sum((F.get(parts, F.lit(i)).cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.when(valid, number)


def _shifted(value: Column, size: Column) -> Column:
    """The number of the block of 2^size that holds the value."""
    return F.call_function("shiftright", value, size)


def _start(number: Column, size: Column) -> Column:
    return F.call_function("shiftleft", number, size)


def blocks(lo: Column, hi: Column) -> Column:
    """The aligned blocks (size, prefix) that make up lo to hi, inclusive; size is the exponent."""
    def inside(number: Column, size: Column) -> Column:
        return (_start(number, size) >= lo) & (_start(number + 1, size) - 1 <= hi)

    def of_size(size: Column) -> Column:
        low = _shifted(lo + _start(F.lit(1).cast("long"), size) - 1, size)
        high = _shifted(hi + 1, size) - 1
        found = F.array_distinct(F.array(low, high))
        kept = F.filter(found, lambda n: inside(n, size) & ((size == BITS) | ~inside(_shifted(n, F.lit(1)), size + 1)))
        return F.transform(kept, lambda n: F.struct(size.alias("size"), n.alias("prefix")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BITS)), of_size))


def match_ranges(addresses: DataFrame, ranges: DataFrame, number: str = "ip_number") -> DataFrame:
    """Left join of addresses (number) to ranges (lo, hi, owner): adds ``owner``, null without a range.

    Ties of width go by lo, then owner. Ranges with a null bound, or with hi below lo, match nothing.
    """
    cut = ranges.where("lo <= hi").select("lo", "hi", "owner", F.explode(blocks(F.col("lo"), F.col("hi"))).alias("b")).select(
        "lo", "hi", "owner", "b.size", "b.prefix")
    sizes = sorted(r["size"] for r in cut.select("size").distinct().collect())  # 33 at most
    if not sizes:
        return addresses.withColumn("owner", F.lit(None).cast("string"))
    distinct = addresses.select(F.col(number).cast("long").alias("_ip")).where("_ip IS NOT NULL").distinct()
    asked = distinct.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes]))).withColumn(
        "prefix", _shifted(F.col("_ip"), F.col("size")))
    best = F.min(F.struct((F.col("hi") - F.col("lo")).alias("width"), "lo", "owner"))
    found = asked.join(cut, ["size", "prefix"]).groupBy("_ip").agg(best.alias("best")).select("_ip", F.col("best.owner").alias("owner"))
    return addresses.join(found, addresses[number].cast("long") == found["_ip"], "left").drop("_ip")
