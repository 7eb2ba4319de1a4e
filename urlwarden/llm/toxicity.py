"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's chance of being toxic is logistic in its words and their stems; the document's is the noisy-or of its
sentences and of a leak that stands for labels no sentence explains. Only documents are labelled;
the fit finds the words whose sentences explain the labels, so a scored document also tells which
sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlwarden.llm.words import MARKS, Words, mix, slices, words_of
from urlwarden.session import materialise

SLICE = 256
# Sentences end at these marks.
STEMS = (4, 5, 6)  # bytes at the start of a word that count as a feature of their own
STOPS = np.zeros(256, dtype=bool)
STOPS[[ord(c) for c in ".!?\n|"]] = True


@dataclass(frozen=True)
class Params:
    """train_docs bounds the labelled documents of the fit, drawn by a hash of doc_id."""

    train_docs: int = 8000
    bits: int = 20
    min_docs: int = 4
    evidence: float = 20.0  # least log-likelihood ratio of a word's presence in labelled documents
    max_words: int = 4096
    steps: int = 400
    rate: float = 0.1
    ridge: float = 0.02
    threshold: float = 0.3


BAG = "toxic int, slots array<int>, sentences array<int>, n long"


@dataclass
class Model:
    """Word slots and weights (sorted by slot), sentence bias, and the document's leak."""

    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -700.0
    leak: float = 0.0


def held_out(doc_id: Column | str) -> Column:
    """Whether a document's labels are kept from the fit; a row without doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bags(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Words]:
    """Slots of each word (itself and its stems), the sentence of each word, the first word of each
    sentence, sentences of each text as bounds, and the words. A sentence is a run of words with no
    stop between. A word too short for a stem has slot 0 there, which never gets a weight."""
    w = words_of(texts, MARKS)
    if not len(w.hash):
        none = np.zeros(0, dtype=np.int64)
        return none.reshape(0, 1 + len(STEMS)), none, none, np.zeros(len(texts) + 1, dtype=np.int64), w
    keys, stem = [w.hash], np.zeros(len(w.hash), dtype=np.uint64)
    for i in range(max(STEMS)):
        stem |= w.buf[np.minimum(w.start + i, len(w.buf) - 1)].astype(np.uint64) << np.uint64(8 * i)
        if i + 1 in STEMS:
            keys.append(np.where(w.end - w.start > i + 1, mix(stem + np.uint64(i << 56)), np.uint64(0)))
    slots = np.stack([(k >> np.uint64(64 - bits)).astype(np.int64) for k in keys], axis=1)
    stops = np.concatenate(([0], np.cumsum(STOPS[w.buf])))
    new = np.concatenate(([True], stops[w.start[1:]] > stops[w.start[:-1]]))
    new[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
    sentence = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    bounds = np.searchsorted(first, w.bounds)
    return slots, sentence, first, bounds, w


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def telling_slots(slot: np.ndarray, n: np.ndarray, k: np.ndarray, total: int, ones: int, p: Params) -> np.ndarray:
    """Slots, sorted, whose presence speaks for the label: found in n of `total` documents, k of
    them among the `ones`, by the log-likelihood ratio against chance."""
    def part(a, among):
        q = np.clip(a / np.maximum(among, 1), 1e-12, 1 - 1e-12)
        return a * np.log(q) + (among - a) * np.log(1 - q)

    ratio = 2 * (part(k, n) + part(ones - k, total - n) - part(ones, total))
    good = np.flatnonzero((slot > 0) & (n >= p.min_docs) & (ratio >= p.evidence) & (k * total > n * ones))
    return np.sort(slot[good[np.argsort(-ratio[good], kind="stable")[: p.max_words]]])


def fit(slot: np.ndarray, bags: list[tuple[np.ndarray, np.ndarray, int]], labels: np.ndarray, p: Params) -> Model:
    """Fit by full-batch gradient steps on the noisy-or likelihood.

    slot: the sorted slots that get weights. bags: for each document its entries among them, the
    sentence of each, and its number of sentences. Without labels of both kinds, or without slots,
    the model is the leak alone.
    """
    rate = float(labels.mean()) if len(labels) else 0.0
    if not 0 < rate < 1 or not len(slot):
        return Model(leak=rate)
    # Sentences with such entries; the others only count for the bias.
    total, base = len(labels), 0
    word, owner, doc_of, plain = [], [], [], np.zeros(total)
    for d, (slots, sentence, count) in enumerate(bags):
        which, own = np.unique(sentence, return_inverse=True)
        word.append(np.searchsorted(slot, slots))
        owner.append(own + base)
        doc_of.append(np.full(len(which), d))
        plain[d] = count - len(which)
        base += len(which)
    word, owner, doc_of = (np.concatenate(x).astype(np.int64) for x in (word, owner, doc_of))
    # Adam on word weights, bias and leak.
    theta = np.concatenate((np.zeros(len(slot)), [-6.0, np.log(rate / (1 - rate)) - 1]))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, p.steps + 1):
        bias, leak = theta[-2], theta[-1]
        z = np.bincount(owner, weights=theta[word], minlength=base) + bias
        none = -(np.bincount(doc_of, weights=_softplus(z), minlength=total) + plain * _softplus(bias) + _softplus(leak))
        chance = -np.expm1(none)  # of the document
        pull = np.where(labels > 0, -np.exp(none) / np.maximum(chance, 1e-12), 1.0)
        gz = pull[doc_of] / (1 + np.exp(-z))
        g = np.concatenate((
            np.bincount(word, weights=gz[owner], minlength=len(slot)),
            [gz.sum() + (pull * plain).sum() / (1 + np.exp(-bias)), pull.sum() / (1 + np.exp(-leak))]))
        g[:-2] += p.ridge * theta[:-2]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= p.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(slot, theta[:-2], float(theta[-2]), float(1 / (1 + np.exp(-theta[-1]))))


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Learn from at most about train_docs labelled documents outside the held-out part.

    labels (doc_id, toxic): null ids and labels are left out, a doc_id with several labels is toxic
    if one of them says so, and null texts are left out. What comes to the driver of the drawn
    documents is the counts of slots, 2 ** bits at most, and then the entries that get weights.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    known = materialise(known, "labels")
    share = min(1.0, p.train_docs / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches):
        for part in slices(batches, SLICE):
            slots, sentence, _, bounds, w = _bags(part.column(1).to_pylist(), p.bits)
            rows = []
            for d in range(part.num_rows):
                a, b = w.bounds[d], w.bounds[d + 1]
                own = sentence[a:b] - bounds[d]
                pair = np.unique(own[:, None] << p.bits | slots[a:b])
                rows.append((pair & ((1 << p.bits) - 1), pair >> p.bits, bounds[d + 1] - bounds[d]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                 pa.array([int(r[2]) for r in rows], pa.int64())],
                names=["toxic", "slots", "sentences", "n"])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # drawn has at most about train_docs rows of two numbers
    bags = materialise(text.where("text IS NOT NULL").join(F.broadcast(drawn), "doc_id").select("toxic", "text")
                       .mapInArrow(run, BAG), "bags")

    def count(batches):
        n, k = (np.zeros(1 << p.bits, dtype=np.int64) for _ in range(2))
        for batch in batches:
            for toxic, slots in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.unique(slots.values.to_numpy())
                n[own] += 1
                k[own] += toxic
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(k[some])], names=["slot", "n", "k"])

    counts = (bags.select("toxic", "slots").mapInArrow(count, "slot long, n long, k long").groupBy("slot")
              .agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("n") >= p.min_docs).toArrow())
    total, ones = bags.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    slot = telling_slots(*(counts.column(c).to_numpy().astype(np.int64) for c in ("slot", "n", "k")), total, ones, p)

    def thin(batches):
        for batch in batches:
            rows = []
            for slots, sentences in zip(batch.column(1), batch.column(2)):
                own = slots.values.to_numpy()
                hit = np.isin(own, slot)
                rows.append((own[hit], sentences.values.to_numpy()[hit]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in (0, 1)], batch.column(3)],
                names=["toxic", "slots", "sentences", "n"])

    rows = sorted(
        ((r["toxic"], np.array(r["slots"], dtype=np.int64), np.array(r["sentences"], dtype=np.int64), r["n"])
         for r in bags.mapInArrow(thin, BAG).toArrow().to_pylist()),
        key=lambda r: (r[0], r[3], len(r[1]), r[1].tobytes()))
    return fit(slot, [r[1:] for r in rows], np.array([r[0] for r in rows], dtype=float), p)


class Scorer:
    """Applies a model to batches of texts inside a task."""

    def __init__(self, model: Model, p: Params):
        self.model, self.p = model, p
        self.weights = np.zeros(1 << p.bits)
        self.weights[model.slots] = model.weights
        self.none = np.log1p(-min(model.leak, 1 - 1e-12))  # log chance that the leak is silent

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """Chance of each document, and its offending sentences."""
        slots, _, first, bounds, w = _bags(texts, self.p.bits)
        none, spans = np.full(len(texts), self.none), [[] for _ in texts]
        if len(first):
            z = np.add.reduceat(self.weights[slots].sum(axis=1), first) + self.model.bias
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            none -= np.bincount(doc, weights=_softplus(z), minlength=len(texts))
            chance = 1 / (1 + np.exp(-z))
            last = np.concatenate((first[1:], [len(slots)])) - 1
            for s in np.flatnonzero(chance >= self.p.threshold):
                raw, o = texts[doc[s]].encode("utf-8", "replace"), w.offsets[doc[s]]
                a, b = w.start[first[s]] - o, w.end[last[s]] - o
                head = len(raw[:a].decode("utf-8", "replace"))
                spans[doc[s]].append({"start": head, "end": head + len(raw[a:b].decode("utf-8", "replace")),
                                      "score": float(chance[s])})
        return -np.expm1(none), spans


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, score, predicted, sentences) of each row of docs (doc_id, text, any others).

    sentences holds the offending ones as (start, end, score): code points of the whole text, end
    exclusive, score at the threshold or above. A null or wordless text scores the leak. Repeated
    rows score alike.
    """

    def run(batches):
        scorer = Scorer(model, p)
        for part in slices(batches, SLICE):
            value, spans = scorer(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(value), pa.array((value >= p.threshold).astype(np.int32)),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))],
                names=["doc_id", "score", "predicted", "sentences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double, predicted int, sentences array<struct<start: long, end: long, score: double>>")


def keep_clean(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted toxic."""
    model = train(docs, labels, p)

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model, p)
        for texts in batches:
            parts = [scorer([t if isinstance(t, str) else None for t in texts.iloc[at : at + SLICE]])[0]
                     for at in range(0, len(texts), SLICE)]
            yield pd.Series(np.concatenate(parts) < p.threshold if parts else np.zeros(0, dtype=bool))

    return docs.where(clean(F.col("text").cast("string")))
