"""Near-duplicate documents: universal-hash minima, banding, signature verification, full-set
confirmation and connected components.

1. Each text becomes its set of distinct word shingles (64-bit hashes), `minima` universal hash
   minima of that set, and a 128-bit fingerprint of the set.
2. Equal sets collapse to the smallest doc_id that has them, by a partial aggregate. A group of
   copies of any size is one node from here on.
3. A node goes to one bucket per band. In a bucket every member is held against one pivot, never
   all against all: first by signatures, then on full sets. The pivots differ from band to band,
   so groups of near copies hang together after one round.
4. What the pivots could not decide is members of different components in one bucket. The members
   outside its most frequent component are held against all of that component and against each
   other, block by block: signatures first, then full sets. Only links that join components leave
   a task.

Nothing is capped or dropped. Two sets of similarity 0.8 share no band of 5 minima in 32 with a
chance of 3e-6, and fail the signature test with one of 2e-7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlwarden.llm.components import connected_components
from urlwarden.llm.words import mix, shingle_hashes, slices, words_of
from urlwarden.session import materialise

SLICE = 128  # texts hashed together
LANE_BLOCKS = 4  # blocks' worth of visitors that meet a block together
TASK_ROWS = 512  # rows of small blocks and lanes that one call takes, on average
BROADCAST_IDS = 1_000_000  # ids, 8 MB: the most that is broadcast; beyond it the join shuffles


@dataclass(frozen=True)
class Params:
    """k words make a shingle; texts link at `percent` of the union or more. With `lower` all letters
    are lower-cased, else A-Z."""

    k: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    block: int = 512
    seed: int = 20240101
    lower: bool = False

    @property
    def minima(self) -> int:
        return self.bands * self.rows

    @property
    def floor(self) -> float:
        """Least share of equal minima: five standard deviations below the similarity asked for."""
        p = self.percent / 100
        return p - 5 * (p * (1 - p) / self.minima) ** 0.5


def text_sets(texts: list[str | None], p: Params) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each whole text."""
    w = words_of([t and t.lower() for t in texts] if p.lower else texts)
    for a, b in zip(w.bounds[:-1], w.bounds[1:]):
        yield np.unique(shingle_hashes(w.hash[a:b], p.k))


def signature(shingles: np.ndarray, factor: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """For each universal hash x -> factor * x + shift (32 bits) its minimum over the set."""
    least = np.full(len(factor), 0xFFFFFFFF, dtype=np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (np.multiply.outer(x[i : i + 512], factor) + shift).min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, signature) of each row; no words: 0 and nulls."""

    def run(batches):
        rng = np.random.default_rng(p.seed)
        factor = rng.integers(0, 1 << 32, p.minima, dtype=np.uint32) | np.uint32(1)
        shift = rng.integers(0, 1 << 32, p.minima, dtype=np.uint32)
        for part in slices(batches, SLICE):
            n, a, b, sig = [], [], [], []
            for s in text_sets(part.column(1).to_pylist(), p):
                n.append(len(s))
                a.append(int(s.sum().astype(np.int64)) if len(s) else None)
                b.append(int(mix(s ^ np.uint64(p.seed)).sum().astype(np.int64)) if len(s) else None)
                sig.append(signature(s, factor, shift).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                 pa.array(sig, pa.binary())],
                names=["doc_id", "n_shingles", "set_a", "set_b", "signature"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def band_rows(nodes: DataFrame, p: Params) -> DataFrame:
    """(key, id): one row for each node and band."""

    def run(batches):
        weights = mix(np.arange(1, p.rows + 1, dtype=np.uint64)) | np.uint64(1)
        salt = mix(np.arange(p.bands, dtype=np.uint64) + np.uint64(p.seed))
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32)
                parts = sig.reshape(-1, p.bands, p.rows).astype(np.uint64)
                keys = mix((parts * weights).sum(axis=2, dtype=np.uint64) ^ salt)
                ids = np.repeat(batch.column(0).to_numpy(), p.bands)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "id"])

    return nodes.select("id", "signature").mapInArrow(run, "key long, id long")


def _alike(p: Params):
    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(x), dtype=np.uint32).reshape(-1, p.minima)
        b = np.frombuffer(b"".join(y), dtype=np.uint32).reshape(-1, p.minima)
        return pd.Series((a == b).mean(axis=1))

    return alike


def _sizes_fit(a: str, b: str, p: Params):
    return F.least(a, b) * 100 >= F.greatest(a, b) * p.percent


def _checked(pairs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """(x, y, share): pairs whose sizes and signatures allow a link."""
    one = nodes.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("signature").alias("sx"))
    two = nodes.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("signature").alias("sy"))
    joined = pairs.join(one, "x").join(two, "y").where(_sizes_fit("nx", "ny", p))
    return joined.select("x", "y", _alike(p)("sx", "sy").alias("share")).where(F.col("share") >= p.floor)


def _full_sets(ids: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """(id, shingles): the full sets of the distinct ids, recomputed from the whole texts."""
    wanted = ids.select(F.col("id").alias("doc_id"))
    if ids.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def run(batches):
        for part in slices(batches, SLICE):
            sets = [s.view(np.int64) for s in text_sets(part.column(1).to_pylist(), p)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(texts.join(wanted, "doc_id", "left_semi").mapInArrow(run, "id long, shingles array<long>"), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """(u, v): the pairs (x, y) that link on their full sets."""
    ids = materialise(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), "ids")
    sets = _full_sets(ids, docs, p)
    one = sets.select(F.col("id").alias("x"), F.col("shingles").alias("a"))
    two = sets.select(F.col("id").alias("y"), F.col("shingles").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return (pairs.select("x", "y").join(one, "x").join(two, "y")
            .select("x", "y", common.alias("i"), (F.size("a") + F.size("b")).alias("t"))
            .where(F.col("i") * 100 >= (F.col("t") - F.col("i")) * p.percent)
            .select(F.col("x").alias("u"), F.col("y").alias("v")))


def _labelled(ids: DataFrame, labels: DataFrame, id_col: str, out: str) -> DataFrame:
    named = labels.select(F.col("node").alias(id_col), F.col("component").alias(out))
    return ids.join(named, id_col, "left").withColumn(out, F.coalesce(out, id_col))


def _like(sig: np.ndarray, n: np.ndarray, others: np.ndarray, i: int, p: Params) -> np.ndarray:
    """Those of others whose size and signature allow a link with i, the likest first."""
    fit = others[np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * p.percent]
    share = (sig[fit] == sig[i]).mean(axis=1)
    return fit[np.argsort(-share, kind="stable")][: int((share >= p.floor).sum())]


def _links_in_blocks(members: DataFrame, visitors: DataFrame, nodes: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """(u, v): links from visitors to members of their groups, as many as join components.

    Both tables are (kind, group, id, c), c the component known so far. Members of a group lie in
    blocks, its visitors in lanes of some blocks' size; a task has one block and one lane, holds
    their full sets, and returns a link only where it joins two components it has not joined yet.
    In groups of kind 0 members and visitors are the same nodes, so each pair is met once.
    """
    key = ["kind", "group"]
    sizes = members.groupBy(*key).agg(F.ceil(F.count("*") / p.block).cast("int").alias("blocks"))
    lanes = visitors.groupBy(*key).agg(F.ceil(F.count("*") / (p.block * LANE_BLOCKS)).cast("int").alias("lanes"))
    rows = members.withColumn("visitor", F.lit(False)).unionByName(visitors.withColumn("visitor", F.lit(True)))
    rows = rows.join(sizes.join(lanes, key), key)

    def spread(own: str, mine, salt: int):
        return F.explode(F.when(mine, F.array(F.pmod(F.xxhash64("id", F.lit(salt)), own).cast("int"))).otherwise(
            F.sequence(F.lit(0), F.col(own) - 1)))

    rows = rows.withColumn("block", spread("blocks", ~F.col("visitor"), 0)).withColumn("lane", spread("lanes", F.col("visitor"), 1))
    rows = materialise(rows.drop("blocks", "lanes"), "blocks")
    sets = _full_sets(materialise(rows.select("id").distinct(), "ids"), docs, p)
    full = rows.join(nodes.select("id", "n", "signature"), "id").join(sets, "id")

    cell = [*key, "block", "lane"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*cell, "visitor", "id"], kind="stable")
        sig = np.frombuffer(b"".join(pdf["signature"]), dtype=np.uint32).reshape(len(pdf), -1)
        ids, n, comp, visitor, sets = (pdf[c].to_numpy() for c in ("id", "n", "c", "visitor", "shingles"))
        cells = pdf[cell].to_numpy()
        cuts = np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1
        found: list[tuple[int, int]] = []
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(pdf)]):
            once, members, joined = cells[lo, 0] == 0, lo + np.flatnonzero(~visitor[lo:hi]), {}

            def root(x):
                while x in joined:
                    x = joined[x]
                return x

            for i in lo + np.flatnonzero(visitor[lo:hi]):
                others = members[comp[members] != comp[i]]
                for j in _like(sig, n, others[ids[others] < ids[i]] if once else others, i, p):
                    x, y = root(comp[i]), root(comp[j])
                    if x == y:
                        continue
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common * 100 >= (len(sets[i]) + len(sets[j]) - common) * p.percent:
                        joined[x] = y
                        found.append((ids[i], ids[j]))
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    # Most blocks are small, so some of them share a call.
    calls = 1 + rows.count() // TASK_ROWS
    return full.groupBy(F.pmod(F.xxhash64(*cell), F.lit(calls)).alias("call")).applyInPandas(run, "u long, v long")


def _of_several(rows: DataFrame) -> DataFrame:
    """Keys of rows (key, c) with more than one component."""
    return rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text, any others).

    A null text, or one without words, has no shingles and links with nothing: component_id is its
    own doc_id and it is kept. A row without doc_id counts alike but for a null component_id; it
    never links. Rows with equal doc_id are one document, whose links are those of all its texts;
    each of them is returned. An empty table gives an empty result.
    """
    sketch = materialise(sketches(docs, p), "sketch")
    full = sketch.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = materialise(
        full.groupBy("set_a", "set_b", F.col("n_shingles").alias("n"))
        .agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature")), "nodes")

    bands = materialise(band_rows(nodes, p), "bands")
    pivots = (bands.groupBy("key").agg(F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("m"), F.count("*").alias("size"))
              .where("size > 1").select("key", F.col("m").bitwiseXOR(F.col("key")).alias("pivot"), "size"))
    members = materialise(bands.join(pivots, "key"), "members")

    # Round 1: the best pivot of each member first; then the pivots that could still join components.
    pairs = materialise(_checked(members.where("id != pivot").select(F.col("id").alias("x"), F.col("pivot").alias("y"))
                                 .distinct(), nodes, p), "pairs")
    best = pairs.groupBy("x").agg(F.max_by("y", F.struct("share", -F.col("y"))).alias("y"))
    repeated = full.join(nodes.select("set_a", "set_b", F.col("n").alias("n_shingles"), "id"),
                         ["set_a", "set_b", "n_shingles"]).where("doc_id != id").select("doc_id", "id")
    # A doc_id with several texts is one document: tie the nodes of its texts together.
    several = full.groupBy("doc_id").agg(F.min("set_a").alias("lo"), F.max("set_a").alias("hi")).where("lo != hi").select("doc_id")
    ties = repeated.join(several, "doc_id").select(F.col("doc_id").alias("u"), F.col("id").alias("v"))
    links = materialise(_confirmed(best, docs, p).union(ties), "links")
    labels = materialise(connected_components(links), "labels")

    # Round 2, where a bucket has members of several components: those outside its most frequent
    # one against that component and each other.
    known = materialise(_labelled(members.select("key", "id"), labels, "id", "c"), "known")
    opened = materialise(known.join(_of_several(known), "key", "left_semi"), "open")
    hosted = (opened.groupBy("key", "c").agg(F.count("*").alias("size")).groupBy("key")
              .agg(F.max_by("c", F.struct("size", -F.col("c"))).alias("host")))
    outside = materialise(opened.join(hosted, "key").where("c != host"), "outside")
    visits = materialise(outside.select("id", "c", F.col("host").alias("group")).distinct().withColumn("kind", F.lit(1)), "visits")
    everyone = _labelled(nodes.select("id"), labels, "id", "group").withColumn("c", F.col("group"))
    hosts = everyone.join(visits.select("group").distinct(), "group", "left_semi").withColumn("kind", F.lit(1))
    peers = outside.join(_of_several(outside), "key", "left_semi").select(
        "id", "c", F.col("key").alias("group")).withColumn("kind", F.lit(0))
    found = _links_in_blocks(hosts.unionByName(peers), visits.unionByName(peers), nodes, docs, p)
    more = _labelled(_labelled(found, labels, "u", "cu"), labels, "v", "cv")
    joined = connected_components(more.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    ids = nodes.select("set_a", "set_b", F.col("n").alias("n_shingles"), "id")
    named = _labelled(_labelled(ids, labels, "id", "first"), joined, "first", "component")
    out = sketch.drop("signature").join(named.drop("id", "first"), ["set_a", "set_b", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    own = F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(~own, component).alias("component_id"),
                      (own | (component == F.col("doc_id"))).alias("kept"))


def keep_one(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs that stay, one document for each group; copies of one row stay once."""
    kept = near_duplicates(docs, p).where("kept")
    many = materialise(kept.where("doc_id IS NOT NULL").groupBy("doc_id").count(), "kept")
    ids = many.select("doc_id")
    stay = docs.where("doc_id IS NULL").unionByName(
        docs.join(F.broadcast(ids) if many.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi").select(docs.columns))
    if many.where("count > 1").limit(1).count() == 0:
        return stay
    twice = many.where("count > 1").select("doc_id")
    once = stay.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(
        F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("row")).select("doc_id", "row.*")
    return stay.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
