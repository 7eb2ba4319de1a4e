"""Personal data by patterns and a skip-chain conditional random field.

Patterns find the base spans. A document's words are then the variables of a random field with the
labels none, email, ip, card and phone. Base words are observed. A word's shape gives its own
potential, neighbours share one, and so do distant words that repeat or resemble each other: the
same letters and digits, the name before an address's @, the last seven digits of a number. Loopy
message passing carries a label from a base span to such words, so what is personal in one place
of a document is personal in all. The weights are learned by pseudo-likelihood on a bounded sample
of documents with base spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urlwarden.llm.words import slices

KINDS = ("email", "ip", "card", "phone")
DIGITS = re.compile(r"[0-9]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"\S+")
EDGES = ".,;:!?\"'()[]{}<>"
LEAST_KEY = 5  # letters and digits a word needs to be linked to others like it
SLICE = 512


@dataclass(frozen=True)
class Params:
    """train_docs bounds the documents the weights are learned from, drawn by a hash of doc_id."""

    train_docs: int = 2000
    steps: int = 200
    prior: float = 0.05
    chain: float = 0.5
    skip: float = 6.0
    sweeps: int = 30
    sure: float = 0.8


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base spans by start, then kind; code points, end exclusive."""
    found = []
    if not text:
        return found
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    ip_done = card_done = 0
    for run in DIGITS.finditer(text):
        if run.start() >= ip_done and (m := IP.match(text, run.start())):
            ip_done = m.end()
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        if run.start() >= card_done and (m := CARD.match(text, run.start())):
            card_done = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


def _shape(word: str) -> list[float]:
    digits = sum("0" <= c <= "9" for c in word)
    return [1.0, "@" in word, digits == 0, 0 < digits < 5, 5 <= digits < 9, 9 <= digits < 12, 12 <= digits < 20, digits >= 20,
            word.count(".") == 3, word[:1] == "+", "-" in word or "(" in word, digits * 2 > len(word)]


def _keys(word: str) -> list[str]:
    """What makes words alike: equal keys. Short words have none."""
    keys = {"".join(c for c in word.lower() if c.isalnum())}
    if "@" in word:
        keys.add("".join(c for c in word.partition("@")[0].lower() if c.isalnum()))
    digits = "".join(c for c in word if "0" <= c <= "9")
    if len(digits) >= 7 and len(digits) * 2 > len(word):
        keys.add("#" + digits[-7:])
    return sorted(k for k in keys if len(k) >= LEAST_KEY)


@dataclass
class Field:
    """The words that matter in one document: those of base spans, those that links over any number
    of words join to them, and others with digits or @. observed is a label, or -1 for a linked word without base span."""

    words: list[tuple[int, int, str]] = field(default_factory=list)
    observed: list[int] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)


def reached(start: list[str], words: list[list[str]]) -> set[str]:
    """The keys that can be reached from those of start by words that have several."""
    beside: dict[str, set[str]] = {}
    for keys in words:
        if len(keys) > 1:
            for k in keys:
                beside.setdefault(k, set()).update(keys)
    known, todo = set(start), list(set(start))
    while todo:
        new = beside.get(todo.pop(), set()) - known
        known |= new
        todo += new
    return known


def document_field(text: str, spans: list[tuple[int, int, int]]) -> Field:
    """The random field of a document with base spans. Each word is linked to the one before it and
    to the last ones with its keys. A word that no chain of such links joins to a base word hears of
    no label: it is observed as none, and left out where it has neither digits nor @."""
    out, words, at = Field(), [], 0
    for m in WORD.finditer(text):
        raw = m[0]
        if raw.isalpha() and len(raw) < LEAST_KEY:
            continue
        core = raw.strip(EDGES)
        start = m.start() + raw.find(core) if core else m.start()
        words.append((start, start + len(core), core))
    base, labels, keys = [], [], [_keys(core) for _, _, core in words]
    for (start, end, _), own in zip(words, keys):
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        hit = next((s for s in spans[at : at + 8] if s[0] < end and start < s[2]), None)
        labels.append(hit[1] + 1 if hit else -1)
        if hit:
            base += own
    known = reached(base, keys)
    last: dict[str, int] = {}
    for (start, end, core), label, own in zip(words, labels, keys):
        if label < 0 and known.isdisjoint(own):
            if "@" not in core and not any("0" <= c <= "9" for c in core):
                continue
            label = 0
        i = len(out.words)
        if out.words and start - out.words[-1][1] <= 2:
            out.chain.append((i - 1, i))
        linked = {last[k] for k in own if k in last}
        out.skip += [(j, i) for j in sorted(linked)]
        last.update(dict.fromkeys(own, i))
        out.words.append((start, end, core))
        out.observed.append(label)
    return out


@dataclass
class Model:
    shape: np.ndarray  # labels x shape features
    chain: float
    skip: float


LABELS = 1 + len(KINDS)
SHAPES = len(_shape(""))


def fit(fields: list[Field], p: Params = Params()) -> Model:
    """Pseudo-likelihood with a Gaussian prior around (0, chain, skip): each observed word's label
    given its shape and its neighbours' labels. What a hidden word is, nobody knows: it teaches
    nothing and counts as no neighbour."""
    x, y, chain, skip = [], [], [], []
    for f in fields:
        seen = [i for i, o in enumerate(f.observed) if o >= 0]
        counts = np.zeros((2, len(f.words), LABELS))
        for kind, pairs in enumerate((f.chain, f.skip)):
            for i, j in pairs:
                counts[kind, i, f.observed[j]] += f.observed[j] >= 0
                counts[kind, j, f.observed[i]] += f.observed[i] >= 0
        x += [_shape(f.words[i][2]) for i in seen]
        y += [f.observed[i] for i in seen]
        chain.append(counts[0, seen])
        skip.append(counts[1, seen])
    model = Model(np.zeros((LABELS, SHAPES)), p.chain, p.skip)
    if not x:
        return model
    x, chain, skip = np.array(x, dtype=float), np.concatenate(chain), np.concatenate(skip)
    target = np.eye(LABELS)[y]
    for step in range(p.steps):
        z = x @ model.shape.T + model.chain * chain + model.skip * skip
        q = np.exp(z - z.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        gap, n = q - target, len(x)
        rate = 1.0 / (1 + step / 50)
        model.shape -= rate * (gap.T @ x / n + p.prior * model.shape)
        model.chain -= rate * ((gap * chain).sum() / n + p.prior * (model.chain - p.chain))
        model.skip -= rate * ((gap * skip).sum() / n + p.prior * (model.skip - p.skip))
    return model


def marginals(f: Field, model: Model, sweeps: int) -> np.ndarray:
    """Label chances of each word by damped loopy sum-product messages."""
    own = np.array([_shape(w[2]) for w in f.words], dtype=float) @ model.shape.T
    for i, o in enumerate(f.observed):
        if o >= 0:
            own[i] = np.where(np.arange(LABELS) == o, 0.0, -50.0)
    pairs = [(i, j, model.chain) for i, j in f.chain] + [(i, j, model.skip) for i, j in f.skip]
    if pairs:
        a = np.array([i for i, _, _ in pairs] + [j for _, j, _ in pairs])  # from
        b = np.array([j for _, j, _ in pairs] + [i for i, _, _ in pairs])  # to
        tie = np.exp(np.array([w for _, _, w in pairs] * 2))[:, None]
        back = np.concatenate((np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))))
        m = np.zeros((len(a), LABELS))
        for _ in range(sweeps):
            total = own.copy()
            np.add.at(total, b, m)
            out = total[a] - m[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(out.sum(axis=1, keepdims=True) + (tie - 1) * out)
            new -= new.mean(axis=1, keepdims=True)
            moved = np.abs(new - m).max()
            m = 0.5 * m + 0.5 * new
            if moved < 1e-4:
                break
        np.add.at(own, b, m)
    q = np.exp(own - own.max(axis=1, keepdims=True))
    return q / q.sum(axis=1, keepdims=True)


def added_spans(text: str, spans: list[tuple[int, int, int]], model: Model, p: Params) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of what the field adds; runs of words of one kind are one span."""
    if not spans:
        return []
    f = document_field(text, spans)
    if all(o >= 0 for o in f.observed):
        return []
    found = []
    for (start, end, _), o, q in zip(f.words, f.observed, marginals(f, model, p.sweeps)):
        kind = int(q[1:].argmax())
        if o >= 0 or q[kind + 1] < p.sure:
            continue
        if found and found[-1][1] == kind and start - found[-1][2] <= 2:
            found[-1] = (found[-1][0], kind, end)
        else:
            found.append((start, kind, end))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def train(docs: DataFrame, p: Params = Params()) -> Model:
    """Learn from the fields of at most about train_docs documents that have base spans. Null ids
    and texts teach nothing; without any base span the weights are those of the prior."""

    def run(frames):
        for pdf in frames:
            out = []
            for text in pdf["text"]:
                if spans := base_spans(text):
                    f = document_field(text, spans)
                    out.append(([w[2] for w in f.words], f.observed, [i for e in f.chain for i in e], [i for e in f.skip for i in e]))
            yield pd.DataFrame(out, columns=["words", "observed", "chain", "skip"])

    known = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Drawn among documents with an @ or five digits, whose number this counts first.
    likely = known.where("text LIKE '%@%' OR text RLIKE '[0-9]{5}' OR text LIKE '%+%'")
    share = min(1.0, p.train_docs / max(1, likely.count()))
    drawn = likely.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.select("text").mapInPandas(run, "words array<string>, observed array<int>, chain array<int>, skip array<int>").toPandas()
    fields = [Field([(0, 0, w) for w in r.words], list(r.observed), list(zip(r.chain[0::2], r.chain[1::2])),
                    list(zip(r.skip[0::2], r.skip[1::2]))) for r in rows.itertuples()]
    return fit(sorted(fields, key=lambda f: [w[2] for w in f.words]), p)


def find(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added) of each row of docs
    (doc_id, text, any others).

    The counts and the hash are of base spans; spans holds all as kind:start:end, added only those
    of the field. A null or empty text has none. Repeated rows give equal results.
    """

    def run(batches):
        for part in slices(batches, SLICE):
            counts, sums, every, more = [[] for _ in KINDS], [], [], []
            for text in part.column(1).to_pylist():
                spans = base_spans(text)
                new = added_spans(text, spans, model, p)
                for k, c in enumerate(counts):
                    c.append(sum(s[1] == k for s in spans))
                sums.append(hashlib.sha256(joined(spans).encode()).hexdigest())
                every.append(joined(sorted(spans + new)))
                more.append(joined(new))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sums, pa.string()),
                 pa.array(every, pa.string()), pa.array(more, pa.string())],
                names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, added string")


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are one."""
    if not spans:
        return text
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs, with all their columns, and personal data in text replaced; n_chars, where
    there is one, is the new length (null for a null text)."""
    model = train(docs, p)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                spans = base_spans(text)
                out.append(masked(text, spans + added_spans(text, spans, model, p)))
            yield pd.Series(out, dtype=object)

    found = docs.withColumn("text", clean(F.col("text").cast("string")))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else found
