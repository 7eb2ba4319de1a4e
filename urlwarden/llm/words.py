"""Vectorised word and shingle hashes over a batch of whole texts, used inside tasks.

A word is a longest run of bytes other than blank, tab, line feed, vertical tab, form feed
and carriage return, with A-Z lower-cased. Words get 64-bit polynomial hashes from prefix
sums, so a batch costs a few array passes and no loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SEGMENT_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

# White space and ASCII punctuation but for apostrophe, hyphen and underscore.
MARKS = BLANK.copy()
MARKS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'-_"]] = True


def slices(batches: Iterable, rows: int) -> Iterator:
    """The Arrow batches of a task in slices of some rows. At the end the worker gives freed memory
    back, as Spark keeps it for other tasks."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class Words(NamedTuple):
    """Words of a batch in text order. bounds[d]:bounds[d + 1] are the words of text d; start and
    end are byte offsets in buf, the lower-cased UTF-8 texts, where text d begins at offsets[d]
    and one blank follows each text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray
    buf: np.ndarray


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i below n at least."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [
            np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, dtype=np.uint64), dtype=np.uint64)))
            for b in (_BASE, inverse)
        ]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, segment: int = SEGMENT_BYTES) -> np.ndarray:
    """Hashes of consecutive spans of a byte array, by their bytes and length."""
    out = np.zeros(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(stop, start[at] + segment, side="right")))
        a, b = start[at], stop[upto - 1]
        up, down = _power_tables(int(b - a) + 1)
        total = np.zeros(int(b - a) + 1, dtype=np.uint64)
        np.cumsum((buf[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
        s, e = start[at:upto] - a, stop[at:upto] - a
        out[at:upto] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _STEP
        at = upto
    return mix(out)


def _segment_words(buf: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = _power_tables(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=total[1:])
    return (total[end] - total[start]) * down[start], start, end


def words_of(texts: list[str | None], blank: np.ndarray = BLANK, segment: int = SEGMENT_BYTES) -> Words:
    """Words of each text; a null text has none. Long batches are cut at blanks into segments."""
    raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)))
    buf = LOWER[np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)]
    is_blank = blank[buf]
    is_blank[offsets[1:] - 1] = True
    hashes, starts, ends, at = [], [], [], 0
    while at < len(buf):
        stop = min(at + segment, len(buf))
        if stop < len(buf):
            back = np.flatnonzero(is_blank[at:stop])
            stop = at + int(back[-1]) + 1 if len(back) else stop + int(np.argmax(is_blank[stop:])) + 1
        h, s, e = _segment_words(buf[at:stop], is_blank[at:stop])
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    h, s, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, starts, ends))
    return Words(mix(h), s, e, np.searchsorted(s, offsets), offsets, buf)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one text in order; with fewer words the whole sequence is one."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    width = min(k, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        out = out * _STEP + hashes[j : n - width + 1 + j]
    return mix(out + np.uint64(width if width < k else 0))
