"""Benchmark passages in documents, by SimHash fingerprints of item-sized windows.

Items and windows are multisets of word shingles. A fingerprint has a bit for each of 128 sums of
random signs over the shingles of a window. Windows come in sizes a constant ratio apart, and each
item is held against the windows of the size nearest its own, which start every fifth of that size.
Fingerprints are met in a multi-index: cut into blocks, two within the radius differ by at most
radius // blocks bits in at least one of them, so looking up each block with that many flipped bits
finds all of them. Around each hit the item's weighted-shingle similarity (sum of smaller counts
over sum of larger ones) is computed exactly for every start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlwarden.llm.words import MARKS, mix, shingle_hashes, slices, words_of

BITS, BLOCKS = 128, 8
SLICE = 128
SEGMENT = 32768  # shingles whose fingerprints are summed together
CHUNK_ITEMS = 2_000  # items that a task holds at a time (160 MB); more are met in further passes


@dataclass(frozen=True)
class Params:
    """k words make a shingle. An item at `least` similarity has its nearest window at about 27 of
    128 bits when sizes and starts fit worst, and 19 when they fit; the radius is three standard
    deviations beyond the worst. Items of up to 7 shingles meet windows of their own size at every
    start, and of those only equal ones are similar enough, at 0 bits, or a shorter whole text."""

    k: int = 5
    least: float = 0.8
    radius: int = 39
    ratio: float = 1.25
    steps: int = 5


def _bits(hashes: np.ndarray) -> np.ndarray:
    """(n x BITS) of 0 and 1 for each shingle hash."""
    both = np.stack((hashes, mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))), axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(hashes), -1), axis=1)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """BITS // 8 bytes: a bit is set where more than half of the shingles have it."""
    return np.packbits(2 * _bits(hashes).sum(axis=0, dtype=np.int64) > len(hashes))


def _near(radius: int) -> np.ndarray:
    """All 16-bit masks with at most radius bits."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(16), r)], dtype=np.uint16)


class Index:
    """Items by window size, with a table per block from its 16 bits to the items that may match."""

    def __init__(self, items: list[tuple[int, str | None]], p: Params):
        self.p, self.items, by_size = p, [], {}
        w = words_of([t for _, t in items], MARKS)
        flips = _near(p.radius // BLOCKS)
        for (item_id, _), a, b in zip(items, w.bounds[:-1], w.bounds[1:]):
            hashes = shingle_hashes(w.hash[a:b], p.k)
            if len(hashes):
                by_size.setdefault(self._size(len(hashes)), []).append(len(self.items))
                self.items.append((item_id, len(hashes), *np.unique(hashes, return_counts=True), fingerprint(hashes)))
        self.sizes = []
        for size, members in sorted(by_size.items()):
            for at in range(0, len(members), 64):
                part = members[at : at + 64]
                prints = np.stack([self.items[i][4] for i in part]).view("<u2")  # items x BLOCKS
                tables = np.zeros((BLOCKS, 1 << 16), dtype=np.uint64)
                for j, row in enumerate(prints):
                    for block, value in enumerate(row):
                        tables[block, flips ^ value] |= np.uint64(1 << j)
                self.sizes.append((size, part, prints.view("<u8"), tables))

    def _size(self, n: int) -> int:
        """The window size nearest n: strides grow by `ratio`, by one at least. Where windows start
        at every shingle, it is n itself."""
        stride = 1
        while True:
            above = max(stride + 1, round(stride * self.p.ratio))
            if n * n <= stride * above * self.p.steps**2:
                return n if stride == 1 else stride * self.p.steps
            stride = above

    def _radius(self, n: int) -> int:
        """No bits for items so small that only an equal window is similar enough."""
        return 0 if self._size(n) == n and n - 1 < self.p.least * n else self.p.radius

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first start, last start) around each window within the radius of an item.

        hashes: shingles of several texts, text d at bounds[d]:bounds[d + 1]. The texts are one
        stream here, and a window counts for the text of its middle; what it has of another is like
        a start that fits less well. Windows are sums of `steps` blocks of a stride each.
        """
        if not len(hashes) or not self.sizes:
            return
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        most = max(s for s, *_ in self.sizes)
        filler = mix(np.arange(1, most + 1, dtype=np.uint64))
        for at in range(0, len(hashes), SEGMENT):
            part = hashes[at : at + SEGMENT + most]
            bits = _bits(np.concatenate((part, filler[: SEGMENT + most - len(part)])))
            room = min(SEGMENT, len(hashes) - at)
            done, words, blocks = 0, None, None
            for size, members, marks, tables in self.sizes:
                stride = max(1, size // self.p.steps)
                steps = size // stride
                if size != done:
                    done, n = size, -(-room // stride)
                    kind = np.uint8 if size < 256 else np.uint32
                    rows = bits[: (n + steps - 1) * stride].reshape(-1, stride, BITS)
                    block = rows[:, 0].astype(kind)
                    for i in range(1, stride):
                        block += rows[:, i]
                    ones = block[:n].copy()
                    for i in range(1, steps):
                        ones += block[i : i + n]
                    prints = np.packbits(ones.ravel() > size // 2).reshape(n, -1)
                    words, blocks = np.ascontiguousarray(prints.view("<u8").T), np.ascontiguousarray(prints.view("<u2").T)
                mask = tables[0][blocks[0]]
                for b in range(1, BLOCKS):
                    mask |= tables[b][blocks[b]]
                for j, item in enumerate(members):
                    near = np.flatnonzero(mask & np.uint64(1 << j))
                    if len(near):
                        apart = np.bitwise_count(words[0][near] ^ marks[j, 0]) + np.bitwise_count(words[1][near] ^ marks[j, 1])
                        for i in near[apart <= self._radius(self.items[item][1])]:
                            start = at + int(i) * stride
                            slack = stride + abs(size - self.items[item][1])
                            yield int(text[min(start + size // 2, len(text) - 1)]), item, start - slack, start + slack

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, float, int, int]]]:
        """For each text its passages: (item_id, similarity, first byte, end byte)."""
        w = words_of(texts, MARKS)
        parts = [shingle_hashes(w.hash[a:b], self.p.k) for a, b in zip(w.bounds[:-1], w.bounds[1:])]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
        hashes = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for d, item, a, b in self.hits(hashes, bounds):
            spans.setdefault((d, item), []).append((max(a, int(bounds[d])), b))
        out: list[list] = [[] for _ in texts]
        for (d, item), ranges in spans.items():
            item_id, n, shingles, counts, _ = self.items[item]
            for start, size, similarity in self._best(hashes, int(bounds[d + 1]), n, shingles, counts, sorted(ranges)):
                one = w.bounds[d] + start - bounds[d]
                two = min(one + size - 1 + self.p.k, w.bounds[d + 1]) - 1
                out[d].append((item_id, similarity, int(w.start[one] - w.offsets[d]), int(w.end[two] - w.offsets[d])))
        return out

    def _best(self, hashes, end, n, shingles, counts, ranges) -> list[tuple[int, int, float]]:
        """(start, size, similarity) of the similar windows, best first, none overlapping another."""
        found = {}
        for a, b in ranges:
            region = hashes[a : min(end, b + n)]
            at = np.searchsorted(shingles, region)
            own = np.where(shingles[np.minimum(at, len(shingles) - 1)] == region, at, len(shingles))
            if (own < len(shingles)).sum() < self.p.least * n:
                continue
            for s in range(0, max(1, min(b - a + 1, len(region) - n + 1))):
                have = np.bincount(own[s : s + n], minlength=len(shingles) + 1)[: len(shingles)]
                size = min(n, len(region) - s)
                common = int(np.minimum(have, counts).sum())
                if common >= self.p.least * (n + size - common):
                    found[a + s] = (common / (n + size - common), size)
        out, taken = [], []
        for s, (similarity, size) in sorted(found.items(), key=lambda x: (-x[1][0], x[0])):
            if all(s >= y or s + size <= x for x, y in taken):
                taken.append((s, s + size))
                out.append((s, size, similarity))
        return out


def _chunks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items with an id and a text, CHUNK_ITEMS at a time; the driver holds one chunk."""
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n = max(1, -(-rows.count() // CHUNK_ITEMS))
    for i in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        if chunk := sorted((r["item_id"], r["text"]) for r in part.collect()):
            yield chunk


def passages(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, item_id, start, end, similarity): each benchmark passage in docs (doc_id, text, any
    others); code points of the whole text, end exclusive.

    Of overlapping windows of one item the most similar counts, then the first. Null texts and
    items, and those without words, match nothing; with fewer than k words all of them are one
    shingle. Equal items and repeated rows are each told. Empty tables give no rows.
    """
    schema = "doc_id long, item_id long, start long, end long, similarity double"
    found = None
    for chunk in _chunks(items):

        def run(batches, chunk=chunk):
            index = Index(chunk, p)
            for part in slices(batches, SLICE):
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = []
                for doc_id, text, matches in zip(ids, texts, index.matches(texts)):
                    raw = text.encode("utf-8", "replace") if matches else b""
                    for item_id, similarity, a, b in matches:
                        head = len(raw[:a].decode("utf-8", "replace"))
                        rows.append((doc_id, item_id, head, head + len(raw[a:b].decode("utf-8", "replace")), similarity))
                columns = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.float64()])],
                    names=["doc_id", "item_id", "start", "end", "similarity"])

        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        part = text.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def keep_clean(docs: DataFrame, items: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark passage."""
    for chunk in _chunks(items):
        docs = docs.where(_clean(chunk, p)(F.col("text").cast("string")))
    return docs


def _clean(chunk: list[tuple[int, str]], p: Params):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(chunk, p)
        for texts in batches:
            values = [t if isinstance(t, str) else None for t in texts]
            yield pd.Series([not m for at in range(0, len(values), SLICE) for m in index.matches(values[at : at + SLICE])], dtype=bool)

    return clean
