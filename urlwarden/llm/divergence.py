"""How the sources of a language differ: smoothed term frequencies compared pair by pair.

Terms come by one pass over bytes: a translation table lowers A-Z and blanks all other ASCII but
a-z, so `split` gives the terms, and a Counter of each document joins the sums of its task. Those
sums, not documents, are shuffled.

The kept terms of a language are dealt to blocks by their hash, each with the counts of all
sources. A block is a dense matrix of terms and sources, so the sums over all terms, absent ones
included, are array passes, and only one number for two sources leaves a block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urlwarden.llm.words import slices
from urlwarden.session import materialise

# Bytes to bytes: A-Z to a-z, a-z and all beyond ASCII to themselves, the rest to blanks.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SCALE = 1_000_000_000
SLICE = 512

CELL = "lang string, source string, term string, n long, docs long"
PART = "lang string, source string, part string, item string, value long"


class Params(NamedTuple):
    """min_docs: documents of a language that must hold a term. top: terms told for a source.
    held: sums a task holds before it hands them on. block: counts of a block, about."""

    min_docs: int = 10
    top: int = 10
    held: int = 1 << 18
    block: int = 1 << 18


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _count(held: int):
    """Sums of (lang, source, term): occurrences and documents. The empty term marks the group itself."""

    def run(batches):
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                size = len(docs) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size), pa.array([source] * size),
                     pa.array([b"", *docs], pa.binary()).cast(pa.string()),
                     pa.array([0, *(n[t] for t in docs)], pa.int64()), pa.array([0, *docs.values()], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        size = 0
        for part in slices(batches, SLICE):
            for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
                size -= len(docs)
                found = Counter(terms_of(text.encode()))
                docs.update(found.keys())
                for term, count in found.items():
                    n[term] += count
                size += len(docs)
                if size > held:
                    yield from rows()
                    size = 0
        yield from rows()

    return run


def count_terms(docs: DataFrame, held: int = Params().held) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group.

    Each group has a row with the empty term too, also where it has no terms.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(_count(held), CELL).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / total) by long division, exact for totals below 2 ** 53."""
    rest = count + 2
    out = np.zeros(np.broadcast(rest, total).shape, dtype=np.int64)
    # The first step is 0 or 1 but for a total of one or two; then three digits a step.
    out += rest // total
    rest = rest % total
    for _ in range(3):
        out = out * 1000 + rest * 1000 // total
        rest = rest * 1000 % total
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _compare(top: int):
    """One block: sums for each two sources of a language, and the terms that may be among the top ones."""

    def run(key, cells: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values("source")
        names, totals = groups["source"].to_numpy(), groups["total"].to_numpy(np.int64)
        whole = groups["lang_total"].to_numpy(np.int64)
        terms, row = np.unique(cells["term"].to_numpy(dtype=object), return_inverse=True)
        column = pd.Index(names).get_indexer(cells["source"])
        counts = cells["n"].to_numpy(np.int64)
        order = np.argsort(row, kind="stable")
        row, column, counts = row[order], column[order], counts[order]
        sums = np.zeros((len(names), len(names)), dtype=np.int64)
        best: list[list[tuple[int, str]]] = [[] for _ in names]
        step = max(1, (1 << 20) // max(1, len(names)))
        for at in range(0, len(terms), step):
            a, b = np.searchsorted(row, [at, at + step])
            dense = np.zeros((min(step, len(terms) - at), len(names)), dtype=np.int64)
            dense[row[a:b] - at, column[a:b]] = counts[a:b]
            p = smoothed(dense, totals)
            for i in range(len(names) - 1):
                sums[i, i + 1 :] += gap(p[:, i : i + 1], p[:, i + 1 :]).sum(axis=0)
            q = smoothed(dense.sum(axis=1), whole[:1])
            for i in range(len(names)):
                above = np.flatnonzero((dense[:, i] > 0) & (p[:, i] > q))
                value = gap(p[above, i], q[above])
                first = np.argsort(-value, kind="stable")[:top]  # terms are sorted, so ties are too
                best[i] = sorted([*best[i], *((-int(value[j]), terms[at + above[j]]) for j in first)])[:top]
        lang = key[0]
        out = [(lang, names[i], "pair", names[j], sums[i, j]) for i in range(len(names)) for j in range(i + 1, len(names))]
        out += [(lang, names[i], "term", t, -v) for i in range(len(names)) for v, t in best[i]]
        return pd.DataFrame(out, columns=["lang", "source", "part", "item", "value"])

    return run


def audit(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Divergence of sources: (lang, source, part, item, value, rank).

    docs (text, lang, source): other columns are not looked at; null counts as ''. Part 'pair' has
    each other source of the language with the sum of (p - q)^2 / (p + q) over all kept terms,
    part 'term' the terms that speak most for a source against its language. Ties go by item. A
    language without kept terms has pairs of value 0, a language of one source no pairs. An empty
    table gives an empty table. Copies of a document count as often as they occur.
    """
    cells = materialise(count_terms(docs, p.held), "cells")
    of_term = Window.partitionBy("lang", "term")
    kept = materialise(
        cells.where("term <> ''").withColumn("all_docs", F.sum("docs").over(of_term))
        .where(F.col("all_docs") >= p.min_docs).select("lang", "source", "term", "n"), "kept-terms")
    # Both are a row for each source, whose square is the size of the result.
    vocabulary = kept.groupBy("lang").agg(F.countDistinct("term").alias("v"), F.sum("n").alias("lang_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_n"))
    zero = F.lit(0).cast("long")
    smooth = 2 * F.coalesce("v", zero)
    groups = (cells.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left")
              .join(vocabulary, "lang", "left")
              .select("lang", "source", (F.coalesce("own_n", zero) + smooth).alias("total"),
                      (F.coalesce("lang_n", zero) + smooth).alias("lang_total")))
    n_blocks = 1 + kept.count() // p.block
    blocked = kept.withColumn("block", F.pmod(F.xxhash64("lang", "term"), F.lit(n_blocks)))
    # A language without kept terms has one block too, so that its pairs come out.
    blocks = blocked.select("lang", "block").unionByName(groups.select("lang", F.lit(0).cast("long").alias("block"))).distinct()
    everywhere = groups.join(blocks, "lang").select(
        *[F.col(c).alias(f"of_{c}") for c in ("lang", "block")], "source", "total", "lang_total")
    parts = materialise(
        blocked.groupBy("lang", "block").cogroup(everywhere.groupBy("of_lang", "of_block"))
        .applyInPandas(_compare(p.top), PART), "parts")
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    back = sums.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value")
    terms = parts.where("part = 'term'")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return (sums.unionByName(back).unionByName(terms).withColumn("rank", F.row_number().over(order))
            .where((F.col("part") == "pair") | (F.col("rank") <= p.top)))
