"""Periodic runs of words, found by tiles of every period octave and stitched from fragments.

A run is a stretch of words with smallest period q (words q apart are equal) that is at least
max(least, 3 * q) words long and that no neighbouring word extends. Octaves hold the periods
from P up to 2P, P a power of two; the first one also holds those below P = GRAM.

In an octave a boundary stands at every P-th word. A run of period q has a boundary b with the
words b to b + 2q inside (b to b + 2 * GRAM for q below GRAM), and there the GRAM words at b come
again at b + q. So one array pass an octave tells the boundaries that may lie in a run, and only
these become tiles: the words around up to GROUP neighbouring boundaries, with P words before the
first and 5P after the last. A boundary whose next 3P words, or those that are left but 2P at
least, have a period below P lies in no run of its octave.

Tiles are rows of their own and dealt over the cluster. At each boundary Z-functions forward and
backward give what of a run lies in the tile: a fragment. Fragments are shuffled by document
and period; those that share q words or more belong to one run.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from urlwarden.llm.words import mix, slices
from urlwarden.session import materialise

GRAM = 8
GROUP = 16
SLICE = 256
BATCH_BYTES = 1 << 21
_STEP = np.uint64(0xD6E8FEB86659FD93)

RUN = "struct<start:long,length:long,period:long>"
FOUND = "doc_id long, key binary, text string, octave int, at long, first int, count int, width int, words binary"
FRAGMENT = "key binary, period long, start long, stop long"


class Params(NamedTuple):
    """least: words of a run at least; it must be three GRAM or more."""

    least: int = 3 * GRAM


class Tile(NamedTuple):
    """Words from `at` on; boundaries stand at first, first + octave, ... (count of them)."""

    octave: int
    at: int
    first: int
    count: int
    words: np.ndarray


def number_words(texts: list[bytes]) -> list[np.ndarray]:
    """The words of each text as numbers, equal for equal words of the batch."""
    index: defaultdict[bytes, int] = defaultdict()
    index.default_factory = index.__len__
    out = []
    for text in texts:
        words = text.split()
        out.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
    return out


def _in_no_run(words: np.ndarray, gram: np.ndarray, octave: int) -> bool:
    """Whether the words from a boundary on, up to three octaves, rule a run of the octave out: too
    few of them are left, or all have one period below the octave."""
    if len(words) < 2 * octave or octave == GRAM:
        return len(words) < 2 * octave
    again = np.flatnonzero(gram[1:octave] == gram[0])
    if not len(again):
        return False
    d = int(again[0]) + 1
    return bool((words[d:] == words[:-d]).all())


def tiles_of(docs: list[np.ndarray], least: int) -> list[list[Tile]]:
    """The tiles of each document of a batch, given by word numbers."""
    out: list[list[Tile]] = [[] for _ in docs]
    # One array for the batch: a number of its own after each document keeps runs apart.
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    if not (sizes >= least).any():
        return out
    words = np.concatenate([part for i, d in enumerate(docs) for part in (d, [-1 - i])]).astype(np.int64)
    hashed = mix(words.view(np.uint64))
    total = len(words)
    gram = np.zeros(total, dtype=np.uint64)
    body = gram[: max(0, total - GRAM + 1)]
    for j in range(GRAM):
        body *= _STEP
        body += hashed[j : j + len(body)]
    octave, left = GRAM, np.flatnonzero(sizes >= least)
    while len(left):
        # Places of the documents that are long enough, and where each stands in its own.
        n = sizes[left]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = within + np.repeat(offsets[left], n)
        back = within & (octave - 1)
        hits = []
        if octave == GRAM:
            some = back > 0
            ref = (place - back)[some]
            hits.append(ref[gram[place[some]] == gram[ref]])
        some = within >= octave
        ref = (place - back - octave)[some]
        hits.append(ref[gram[place[some]] == gram[ref]])
        hot = np.unique(np.concatenate(hits))
        owner = np.searchsorted(offsets, hot, side="right") - 1
        group: list[int] = []
        for d, b in zip([*owner.tolist(), -1], [*hot.tolist(), -1]):
            end = b < 0 or group and (b != group[-1] + octave or len(group) == GROUP or d != last)
            if end and group:
                base = int(offsets[last])
                lo, hi = max(base, group[0] - octave), min(base + int(sizes[last]), group[-1] + 5 * octave)
                out[last].append(Tile(octave, lo - base, group[0] - lo, len(group), words[lo:hi]))
                group = []
            if b >= 0:
                stop = min(int(offsets[d] + sizes[d]), b + 3 * octave)
                if not _in_no_run(words[b:stop], gram[b : b + octave], octave):
                    group.append(b)
                last = d
        octave *= 2
        left = left[sizes[left] >= 3 * octave]
    return out


def z_function(words: list[int], upto: int) -> list[int]:
    """For each shift below `upto` the length of what the words and the shifted words begin with alike."""
    n = len(words)
    upto = min(upto, n)
    z = [0] * upto
    left = right = 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and words[k] == words[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _prime_divisors(n: int) -> list[int]:
    out, d = [], 2
    while d * d <= n:
        if n % d == 0:
            out.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return out + [n] * (n > 1)


def fragments_of(tile: Tile) -> list[tuple[int, int, int]]:
    """(period, start, stop) of what the tile shows of runs, by word numbers of the document."""
    out = []
    words, p = tile.words.tolist(), tile.octave
    for b in range(tile.first, tile.first + tile.count * p, p):
        forward = z_function(words[b : b + 5 * p], 2 * p)
        found = []
        for q in range(1 if p == GRAM else p, len(forward)):
            # All of b to b + 2q repeats, and the first q words are no power of a shorter word.
            if forward[q] >= max(q, 2 * GRAM - q) and not any(forward[q // r] >= q - q // r for r in _prime_divisors(q)):
                found.append(q)
        if not found:
            continue
        lo = max(0, b - p)
        before = words[lo:b][::-1]
        backward = z_function([*before, -1, *words[lo : b + 2 * p][::-1]], 4 * p + 1)
        stop = min(len(words), b + 2 * p)
        for q in found:
            # In the reversed copy the word before b + q stands at this place.
            behind = backward[len(before) + 1 + stop - (b + q)] if before else 0
            out.append((q, tile.at + b - behind, tile.at + b + q + forward[q]))
    return out


def _key(doc_id: int | None, text: bytes) -> bytes:
    return hashlib.blake2b(b"%a\n" % doc_id + text, digest_size=16).digest()


def _screened(batches, least: int) -> Iterator[tuple[list, list[bytes], list[list[Tile]]]]:
    """Slices of a task's documents with their tiles."""
    for part in slices(batches, SLICE):
        texts = [(t or "").encode() for t in part.column(1).to_pylist()]
        yield part.column(0).to_pylist(), texts, tiles_of(number_words(texts), least)


def _plain(least: int):
    """Documents without a tile, their words joined by one blank."""

    def run(batches):
        for ids, texts, tiles in _screened(batches, least):
            keep = [i for i, t in enumerate(tiles) if not t]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in keep], pa.int64()),
                 pa.array([b" ".join(texts[i].split()) for i in keep], pa.binary()).cast(pa.string())],
                names=["doc_id", "text"])

    return run


def _explode(least: int):
    """Documents with tiles: one row each, and one row for each tile. Copies of a document within
    a task give their tiles once."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("text", pa.string()), ("octave", pa.int32()),
                        ("at", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("width", pa.int32()),
                        ("words", pa.binary())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        seen: set[bytes] = set()
        rows, held = [], 0
        for ids, texts, tiles in _screened(batches, least):
            for doc_id, text, own in zip(ids, texts, tiles):
                if not own:
                    continue
                key = _key(doc_id, text)
                rows.append((doc_id, key, text.decode(), None, None, None, None, None, None))
                held += len(text)
                for t in own if key not in seen else []:
                    # Numbers within the tile take two bytes mostly.
                    names, numbers = np.unique(t.words, return_inverse=True)
                    width = 2 if len(names) < 1 << 16 else 4
                    rows.append((None, key, None, t.octave, t.at, t.first, t.count, width,
                                 numbers.astype(f"<u{width}").tobytes()))
                    held += width * len(numbers)
                    if held > BATCH_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                seen.add(key)
        if rows:
            yield batch(rows)

    return run


def _solve(batches):
    for part in slices(batches, 64):
        rows = []
        for r in part.to_pylist():
            words = np.frombuffer(r["words"], dtype=f"<u{r['width']}").astype(np.int64)
            tile = Tile(r["octave"], r["at"], r["first"], r["count"], words)
            rows += [(r["key"], *f) for f in fragments_of(tile)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))],
                names=["key", "period", "start", "stop"])


def _collapse(batches):
    """Words that a run holds after its first period go; the others are joined by one blank."""
    for part in slices(batches, SLICE):
        texts = []
        for text, runs in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
            words = (text or "").encode().split()
            keep = np.ones(len(words), dtype=bool)
            for r in runs:
                keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
            texts.append(b" ".join([words[i] for i in np.flatnonzero(keep)]))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), part.column(2)],
            names=["doc_id", "text", "runs"])


def stitch(fragments: DataFrame, least: int) -> DataFrame:
    """Runs (key, start, length, period) from fragments (key, period, start, stop).

    Fragments of one period that share a whole period are parts of one run. Repeated fragments
    are dropped within the tasks first, so copies of a document do not fill a group.
    """
    inside = Window.partitionBy("key", "period").orderBy("start", "stop")
    reach = F.max("stop").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(reach - F.col("start") >= F.col("period"), 0).otherwise(1)
    runs = (fragments.distinct().withColumn("_new", apart)
            .withColumn("_run", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("key", "period", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("_stop"))
            .withColumn("length", F.col("_stop") - F.col("start")))
    return runs.where(F.col("length") >= F.greatest(F.lit(least), 3 * F.col("period"))).select(
        "key", "start", "length", "period")


def collapse(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Runs of each document and the text without their repeats: (doc_id, text, runs).

    docs (doc_id, text): other columns are not looked at. Words are longest pieces without blank,
    tab, line feed, vertical tab, form feed and carriage return. runs are ordered by start, then
    period; text holds the words that no run holds after its first period, joined by one blank. A
    null or empty text has no words: text '' and no runs. Null and repeated doc_ids stay rows of
    their own; an empty table gives an empty table. The runs of a document are one array, which is
    shorter than the document.
    """
    spark = docs.sparkSession
    least = max(p.least, 3 * GRAM)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = rows.mapInArrow(_plain(least), "doc_id long, text string")
    found = materialise(rows.mapInArrow(_explode(least), FOUND), "tiles")
    # Tiles are little data and much work: their number of tasks is fixed, not taken from their bytes.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fragments = (found.where("words IS NOT NULL").select("key", "octave", "at", "first", "count", "width", "words")
                 .repartition(n, "key", "octave", "at").mapInArrow(_solve, FRAGMENT))
    runs = stitch(fragments, least).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    none = F.array().cast(f"array<{RUN}>")
    held = (found.where("text IS NOT NULL").select("doc_id", "key", "text").join(runs, "key", "left")
            .select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
            .mapInArrow(_collapse, f"doc_id long, text string, runs array<{RUN}>"))
    return plain.select("doc_id", "text", none.alias("runs")).unionByName(held)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, by whole numbers; ties: smallest start, then period."""
    def order(a, b):
        left, right = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(left > right, -1).when(left < right, 1)
                .when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
                .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))

    return F.get(F.array_sort(runs, order), F.lit(0))
