"""Near-duplicate vectors: one small-world graph per shard, every shard asked for every vector,
beams widened until recall audits pass, exact cosines, connected components.

Equal vectors are one node with a count. A link is a pair of cosine 0.9 or more in double precision.
Each block of queries is audited in each shard: some of its queries are also compared with all of
the shard's vectors, and while too few of their links were found the whole block is asked again
with a beam twice as wide, at last as wide as the shard. A pair can be found from either side.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlwarden.llm.components import connected_components
from urlwarden.llm.hnsw import Graph
from urlwarden.session import materialise


@dataclass(frozen=True)
class Params:
    least: float = 0.9
    shards: int = 8  # at least; more where a shard would pass shard_vectors
    shard_vectors: int = 50_000
    lanes: int = 3  # tasks that ask one shard
    block: int = 512  # queries asked and audited together
    audits: int = 64  # queries of a block that are audited
    recall: float = 0.99
    beam: int = 32
    degree: int = 16


def _good() -> Column:
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("vec_id").isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def _usable(rows: DataFrame) -> DataFrame:
    """(vec_id, v, a, b): usable vectors divided by their largest part, which keeps the squares from
    overflow and underflow, and the 128-bit hash by which rows find their node."""
    scaled = rows.where(_good()).withColumn("top", F.array_max(F.transform("v", F.abs)))
    scaled = scaled.select("vec_id", F.transform("v", lambda x: x / F.col("top") + F.lit(0.0)).alias("v"))
    return scaled.select("vec_id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.reverse("v"), F.size("v")).alias("b"))


def _nodes(rows: DataFrame) -> DataFrame:
    """(id, a, b, copies, dim, v) of the distinct usable vectors; v has unit length."""
    groups = _usable(rows).groupBy("a", "b").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    unit = groups.withColumn("unit", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    return unit.select("id", "a", "b", "copies", F.size("v").alias("dim"), F.transform("v", lambda x: x / F.col("unit")).alias("v"))


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("id").to_numpy()
    return ids, batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


PACKED = "shard int, lane int, dim int, query boolean, ids binary, vectors binary, links array<binary>"


def _packed(shard, lane, dim, query, ids, vectors, links=()) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.list_(pa.binary())]
    values = [shard, lane, dim, query, ids.tobytes(), np.ascontiguousarray(vectors, dtype=np.float64).tobytes(), [x.tobytes() for x in links]]
    names = [f.split()[0] for f in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds)], names=names)


def _unlinked(rows: DataFrame) -> DataFrame:
    """The rows that _usable leaves out, with no links."""
    return rows.where(~_good()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))


def build_graphs(nodes: DataFrame, dim: int, shards: int, p: Params) -> DataFrame:
    """One row per shard: its vectors and the graph's links."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            ids, v = _rows(batch)
            own = batch.column("shard").to_numpy()
            for s in np.unique(own):
                held.setdefault(int(s), []).append((ids[own == s], v[own == s]))
        for s, parts in sorted(held.items()):
            ids, v = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
            order = np.argsort(ids, kind="stable")
            g = Graph.build(v[order], p.degree)
            yield _packed(s, 0, dim, False, ids[order], v[order], g.links)

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    return nodes.where(F.col("dim") == dim).select("id", "v", shard.alias("shard")).repartition(shards, "shard").mapInArrow(run, PACKED)


def _links(graphs: DataFrame, nodes: DataFrame, dim: int, shards: int, p: Params) -> DataFrame:
    """(u, v): the pairs found, u < v. Each task holds one graph and streams its blocks of queries."""

    def blocks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, p.block):
                ids, v = _rows(batch.slice(at, p.block))
                yield _packed(-1, int(ids[0] % p.lanes), dim, True, ids, v)

    def ask(batches):
        ids, g = None, None
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["ids"], dtype=np.int64)
                v = np.frombuffer(row["vectors"], dtype=np.float64).reshape(len(own), -1)
                if not row["query"]:
                    links = [np.frombuffer(x, dtype=np.int32).reshape(len(own), -1) for x in row["links"]]
                    ids, g = own, Graph(v, links, 0)
                    continue
                if g is None:  # a shard without vectors
                    continue
                found = audited(g, v, p)
                a = np.repeat(own, [len(x) for x in found])
                b = ids[np.concatenate(found)] if len(a) else a
                pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)[a != b], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["u", "v"])

    asked = nodes.where(F.col("dim") == dim).select("id", "v").repartition(
        max(1, shards)).mapInArrow(blocks, PACKED).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    lanes = graphs.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(p.lanes - 1))))
    both = lanes.unionByName(asked).repartition(shards * p.lanes, "shard", "lane").sortWithinPartitions("shard", "lane", "query")
    return both.mapInArrow(ask, "u long, v long")


def audited(g: Graph, queries: np.ndarray, p: Params) -> list[np.ndarray]:
    """Links of each query, found with the first beam whose audit passes."""
    some = np.linspace(0, len(queries) - 1, min(p.audits, len(queries))).astype(int)
    true = [np.flatnonzero(row) for row in queries[some] @ g.x.T >= p.least]
    beam = p.beam
    while True:
        found = g.within(queries, p.least, beam)
        hit = sum(np.isin(t, found[i], assume_unique=True).sum() for i, t in zip(some, true))
        if hit >= p.recall * sum(map(len, true)) or beam >= len(g.x):
            return found
        beam *= 2


def near_duplicates(rows: DataFrame, p: Params = Params()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows (vec_id, embedding, any others).

    A vector that is null, empty, zero, or has a null or non-finite part links with nothing, and
    vectors of different lengths do not link. A row without vec_id is returned with a null
    component_id, kept, and links with nothing. Rows of one vec_id are one vector each for n_links
    and one node for the components. An empty table gives no rows.
    """
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    nodes = materialise(_nodes(kept), "nodes")
    pairs = None
    for dim, n in sorted((r["dim"], r["count"]) for r in nodes.groupBy("dim").count().collect()):
        shards = max(p.shards, -(-n // p.shard_vectors))
        graphs = materialise(build_graphs(nodes, dim, shards, p), "graphs")
        found = materialise(_links(graphs, nodes, dim, shards, p).distinct(), "pairs")
        pairs = found if pairs is None else pairs.unionByName(found)
    if pairs is None:
        return _unlinked(kept).withColumn("kept", F.lit(True))
    ends = pairs.select(F.col("u").alias("id"), F.col("v").alias("other")).union(pairs.select(F.col("v").alias("id"), F.col("u").alias("other")))
    copies = nodes.select(F.col("id").alias("other"), "copies")
    links = ends.join(copies, "other").groupBy("id").agg(F.sum("copies").alias("others"))
    groups = connected_components(pairs).withColumnRenamed("node", "id")
    known = nodes.join(links, "id", "left").join(groups, "id", "left").select(
        "a", "b", F.coalesce("component", "id").alias("component"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"))
    told = _usable(kept).select("vec_id", "a", "b").join(known, ["a", "b"])
    linked = told.select("vec_id", F.col("n").alias("n_links"), F.col("component").alias("component_id"))
    return linked.unionByName(_unlinked(kept)).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
