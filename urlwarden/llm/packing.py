"""Best-fit packing of documents into training sequences, with conflicts.

Every document is cut into pieces of at most `capacity` tokens. Pieces go, longest first, to the
open bin with the least room that still holds them, unless that bin already has a document of the
same source or of the same duplicate cluster (near-duplicate components, or else exact copies); then the search goes on to the next larger room, and
a new bin opens if none is compatible. Bins lie ordered by room and carry one bitmap of sources
and one of clusters.

Documents are dealt to packs of about `pack_docs` by a hash of their id, so a pack is bounded
whatever its sources are, and a source or cluster with a third of all rows is spread over all.
Rows that repeat one id, or one text without id, so often that they would crowd a pack are dealt
by their place in a table written before.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from urlwarden.llm import near_dups
from urlwarden.session import materialise


@dataclass(frozen=True)
class Params:
    capacity: int = 2048
    pack_docs: int = 2048


class Bins:
    """Open bins ordered by room. Bitmaps are rows of 64-bit words, one column per bin."""

    def __init__(self, most: int, sources: int, clusters: int):
        self.room = np.zeros(most, dtype=np.int64)  # ascending, the first `n` are open
        self.bin = np.zeros(most, dtype=np.int64)
        self.n = self.opened = 0
        self.bits = [np.zeros((max(1, -(-k // 64)), most), dtype=np.uint64) for k in (sources, clusters)]

    def place(self, size: int, capacity: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, tokens in it before) for a piece; -1 as source or cluster conflicts with nothing."""
        at = int(np.searchsorted(self.room[: self.n], size))
        free = np.ones(self.n - at, dtype=bool)
        for bits, member in zip(self.bits, (source, cluster)):
            if member >= 0:
                free &= bits[member >> 6, self.bin[at : self.n]] >> np.uint64(member & 63) & np.uint64(1) == 0
        fit = int(np.argmax(free)) if free.any() else -1
        if fit < 0:
            room, name, gone = capacity, self.opened, self.n
            self.opened += 1
            self.n += 1
        else:
            gone = at + fit
            room, name = int(self.room[gone]), int(self.bin[gone])
        left = room - size
        to = int(np.searchsorted(self.room[: gone if fit >= 0 else self.n - 1], left))
        for a in (self.room, self.bin):
            a[to + 1 : gone + 1] = a[to:gone]
        self.room[to], self.bin[to] = left, name
        for bits, member in zip(self.bits, (source, cluster)):
            if member >= 0:
                bits[member >> 6, name] |= np.uint64(1 << (member & 63))
        return name, capacity - room


def pack(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Place the pieces (doc_id, piece, n, source, cluster) of one pack; adds bin and offset.
    Ties of length go by doc_id and piece; of bins with equal room the one filled last comes first."""
    order = pieces.assign(key=-pieces["n"]).sort_values(["key", "doc_id", "piece"], kind="stable", na_position="last").drop(columns="key")
    source, cluster = pd.factorize(order["source"])[0], pd.factorize(order["cluster"])[0]
    bins = Bins(len(order), source.max(initial=-1) + 1, cluster.max(initial=-1) + 1)
    placed = [bins.place(int(n), capacity, int(s), int(c)) for n, s, c in zip(order["n"], source, cluster)]
    return order.assign(bin=[b for b, _ in placed], offset=[o for _, o in placed])


def near_clusters(docs: DataFrame, key: str, near: near_dups.Params) -> DataFrame:
    """(key, component): the keys of docs (key, text) whose near-duplicate component has a smaller key."""
    found = near_dups.near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"), replace(near, lower=True))
    return (found.where("n_shingles > 0 AND component_id != doc_id").groupBy(F.col("doc_id").alias(key))
            .agg(F.min("component_id").alias("component")))


@F.pandas_udf(T.LongType())
def word_count(texts: pd.Series) -> pd.Series:
    """Longest pieces without blank, tab, line feed, vertical tab, form feed and carriage return."""
    return pd.Series([0 if t is None else len(t.encode().split()) for t in texts], dtype="int64")


def packed(docs: DataFrame, p: Params = Params(), cluster: str | None = None, near: near_dups.Params | None = None) -> DataFrame:
    """One row per piece: bin_id, slot, doc_id, piece, first_token, n_tokens, source, cluster.

    bin_id is pack:bin; slot is the piece's first token in the bin; first_token its first token in
    the document. Tokens are words. `cluster` names a column with a document's duplicate cluster.
    With `near` it is the near-duplicate component of the lower-cased text instead, its smallest
    doc_id; copies without doc_id are one document there, named by a hash of 2^62 or more. Without
    either it is the hash of the lower-cased words, so only exact copies share a cluster. A null
    source or cluster conflicts with nothing. A null text, or one without words, is a piece of no
    tokens, so no document is lost. A row without doc_id is dealt by its text. Repeated rows are
    pieces of their own. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("_words", word_count(F.col("text").cast("string")))
    words = F.col("_words")
    plain = F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))
    own = F.col(cluster).cast("string") if cluster else F.when(words > 0, F.xxhash64(plain).cast("string"))
    doc_id = F.col("doc_id").cast("long")
    key = F.coalesce(doc_id, F.shiftrightunsigned(F.xxhash64(plain), 2).bitwiseOR(F.lit(1 << 62)))
    items = docs.select(
        doc_id.alias("doc_id"), words.alias("words"),
        F.col("source").cast("string").alias("source"), (F.when(words > 0, key) if near else own).alias("cluster"),
        F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), text)).alias("deal"))
    if near:  # words are counted before the join, so no text is shuffled
        found = near_clusters(docs.select(key.alias("cluster"), text.alias("text")), "cluster", near)
        items = items.join(found, "cluster", "left").withColumn("cluster", F.coalesce("component", "cluster").cast("string"))
    items = materialise(items.withColumn("place", F.monotonically_increasing_id()), "pack-items")
    packs = max(1, -(-items.count() // p.pack_docs))
    often = items.groupBy("deal").agg(F.count("*").alias("rows")).where(F.col("rows") > p.pack_docs // 8)
    items = items.join(often, "deal", "left").withColumn(
        "deal", F.when(F.col("rows").isNull(), F.col("deal")).otherwise(F.xxhash64("deal", "place")))
    last = F.greatest(F.lit(0), F.ceil(F.col("words") / p.capacity) - 1).cast("int")
    first = F.col("piece").cast("long") * p.capacity
    pieces = (items.select("*", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
              .select("doc_id", "piece", "source", "cluster", F.least(F.lit(p.capacity), F.col("words") - first).alias("n"),
                      F.pmod("deal", F.lit(packs)).alias("pack")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack(pdf, p.capacity)
        out["bin_id"] = [f"{a}:{b}" for a, b in zip(out["pack"], out["bin"])]
        out["first_token"] = out["piece"].astype("int64") * p.capacity
        return out.rename(columns={"offset": "slot", "n": "n_tokens"})[
            ["bin_id", "slot", "doc_id", "piece", "first_token", "n_tokens", "source", "cluster"]]

    return pieces.groupBy("pack").applyInPandas(
        run, "bin_id string, slot long, doc_id long, piece int, first_token long, n_tokens long, source string, cluster string")


def bins(pieces: DataFrame) -> DataFrame:
    """One row per bin: bin_id, n_tokens, and its pieces (slot, doc_id, piece, n_tokens) in order.
    A bin holds one document of a source at most, so the list is bounded by the pack."""
    parts = F.sort_array(F.collect_list(F.struct("slot", "doc_id", "piece", "n_tokens")))
    return pieces.groupBy("bin_id").agg(F.sum("n_tokens").alias("n_tokens"), parts.alias("pieces"))
