"""Language identification by a string kernel.

Two texts are compared by the n-grams they both have: a blended spectrum of 1 to 3 letters, each
counted as present or not, normalised by the sizes of the two sets. Nyström landmarks turn the
kernel into a short vector, on which one ridge regression per language against the rest is fitted.
Scoring a batch is two matrix products: presences by landmarks, and kernels by languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlwarden.llm.words import slices
from urlwarden.session import materialise

SYMBOLS = 64
GRAMS = SYMBOLS + SYMBOLS**2 + SYMBOLS**3
SLICE = 32
UNKNOWN = "und"
MANY_LANGS = 100_000


@dataclass(frozen=True)
class Params:
    """per_lang bounds the texts a language is learned from, drawn by a hash of doc_id; landmarks
    of them, shared among the languages, span the kernel's vectors."""

    per_lang: int = 300
    landmarks: int = 96
    ridge: float = 0.1
    sharpness: float = 5.0


@dataclass
class Model:
    """langs; the grams that landmarks have; landmarks by gram presence; kernel to language weights."""

    langs: list[str]
    grams: np.ndarray
    presence: np.ndarray
    weights: np.ndarray
    bias: np.ndarray


_symbols: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    """Class of each code point below 65,536: 0 no letter, 1-26 a-z, else one of 37 by a hash."""
    if not _symbols:
        table = np.zeros(1 << 16, dtype=np.uint8)
        for i in range(1 << 16):
            c = chr(i).lower()
            if c[0].isalpha():
                table[i] = ord(c[0]) - 96 if "a" <= c[0] <= "z" else 27 + (ord(c[0]) * 2654435761 >> 12) % 37
        _symbols.append(table)
    return _symbols[0]


def presences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(texts x GRAMS) presence of each n-gram, and whether the text has a letter."""
    table = _symbol_table()
    flags = np.zeros((len(texts), GRAMS), dtype=bool)
    letters = np.zeros(len(texts), dtype=bool)
    for d, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
        high = points >= 1 << 16
        s = table[np.where(high, 0, points)].astype(np.int32)
        if high.any():
            for i in np.flatnonzero(high):
                if chr(points[i]).isalpha():
                    s[i] = 27 + int(points[i]) % 37
        letters[d] = s.any()
        row, base, code = flags[d], 0, s
        for order in range(1, 4):
            row[base + code] = True
            base += SYMBOLS**order
            if len(s) <= order:
                break
            code = code[:-1] * SYMBOLS + s[order:]
    return flags, letters


def held_out(doc_id: str) -> Column:
    """Whether a document is kept from the fit; a row without doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(langs: list[str], codes: list[np.ndarray], p: Params) -> Model | None:
    """Fit on the gram sets of labelled texts; None without any."""
    if not langs:
        return None
    names = sorted(set(langs))
    order = sorted(range(len(langs)), key=lambda i: (langs[i], len(codes[i]), codes[i].tobytes()))
    rng = np.random.default_rng(7)
    chosen = []
    for name in names:
        own = [i for i in order if langs[i] == name]
        chosen += list(rng.permutation(own)[: max(1, p.landmarks // len(names))])
    grams = np.unique(np.concatenate([codes[i] for i in chosen]))

    def dense(which):
        out = np.zeros((len(which), len(grams)), dtype=np.float32)
        for r, i in enumerate(which):
            at = np.searchsorted(grams, codes[i])
            hit = grams[np.minimum(at, len(grams) - 1)] == codes[i]
            out[r, at[hit]] = 1
        return out / np.sqrt([[len(codes[i])] for i in which], dtype=np.float32)

    marks = dense(chosen)
    value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])  # kernels with the landmarks -> Nyström vectors
    x = (dense(order) @ marks.T).astype(np.float64) @ root
    y = np.array([[1.0 if langs[i] == name else -1.0 for name in names] for i in order])
    mean, level = x.mean(axis=0), y.mean(axis=0)
    x = x - mean
    w = np.linalg.solve(x.T @ x + p.ridge * np.eye(x.shape[1]), x.T @ (y - level))
    return Model(names, grams, marks, (root @ w).astype(np.float32), (level - mean @ w).astype(np.float32))


def train(docs: DataFrame, p: Params = Params()) -> Model | None:
    """Learn from about per_lang texts of each non-null lang outside the held-out part.

    Only gram sets of the drawn texts come to the driver: per_lang times the number of languages.
    Rows without doc_id, lang, text or letters teach nothing.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                        F.col("text").cast("string").alias("text")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id"))
    shares = known.groupBy("lang").count().select(
        "lang", (F.least(F.lit(1.0), p.per_lang / F.col("count")) * (1 << 30)).cast("long").alias("limit"))
    shares = materialise(shares, "shares")
    # a row per language; only an unheard-of number of them is too many to send to every task
    shares = F.broadcast(shares) if shares.count() <= MANY_LANGS else shares
    drawn = known.join(shares, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.col("limit"))

    def run(batches):
        for part in slices(batches, SLICE):
            flags, letters = presences(part.column(1).to_pylist())
            codes = [np.flatnonzero(f).astype(np.int32) if ok else np.zeros(0, np.int32) for f, ok in zip(flags, letters)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.list_(pa.int32()))], names=["lang", "codes"])

    found = drawn.where("text IS NOT NULL").select("lang", "text").mapInArrow(run, "lang string, codes array<int>").toArrow()
    rows = [(g, np.array(c, dtype=np.int64)) for g, c in zip(found.column(0).to_pylist(), found.column(1).to_pylist()) if c]
    return fit([r[0] for r in rows], [r[1] for r in rows], p)


def predict(docs: DataFrame, model: Model | None, p: Params = Params()) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs (doc_id, text, any others), from text alone.

    score is the winner's share in a softmax of the regressions. A null text, or one without a
    letter, is `und` with score 0, as is every text without a model. Of equal scores the first
    language by name wins.
    """

    def run(batches):
        for part in slices(batches, SLICE):
            flags, letters = presences(part.column(1).to_pylist())
            if model is None:
                names, top = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
            else:
                size = np.sqrt(np.maximum(np.count_nonzero(flags, axis=1), 1)).astype(np.float32)
                kernel = flags[:, model.grams].astype(np.float32) @ model.presence.T / size[:, None]
                s = (kernel @ model.weights + model.bias).astype(np.float64) * p.sharpness
                e = np.exp(s - s.max(axis=1, keepdims=True))
                best = s.argmax(axis=1)
                top = np.where(letters, e[np.arange(len(e)), best] / e.sum(axis=1), 0.0)
                names = [model.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(top)],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")
