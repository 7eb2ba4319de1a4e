"""Token ids of a corpus in wavelet matrices, one per shard and file.

A shard holds the ids of a run of whole documents in ascending doc_id order. Its matrix has one
bit-plane for each bit of an id, highest bit first; below each plane the ids are dealt stably into
those with 0 and those with 1. With a rank directory for every 512 bits, one file answers

* access: the id at a position,
* rank and count: how often an id occurs, in a prefix or in all,
* select: the position of the j-th occurrence,

in one step per plane, without decoding the shard. A shard is one row in a zstd Parquet file of
its own, so Spark's commit protocol keeps it whole when an executor is lost and every store that
Spark reads can hold it.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from urlwarden.llm.words import BLANK, slices, span_hashes

END_ID = 2
SHARD_TOKENS = 1 << 23
CACHE_PIECES = 2_000_000
CACHE_IDS = 8 * CACHE_PIECES
SLOT_BITS = 20
BLOCK_BITS = 512
SLICE = 256  # texts cut together
SHARD_SCHEMA = ("part int, seq int, n_tokens long, planes array<binary>, ranks array<binary>, zeros array<long>, "
                "doc_ids array<long>, lengths array<long>")

# What the byte-level splitter never cuts across: a blank stays with the word after it, and of a
# longer run of white space only the last blank does. Letters before a full stop or comma end a
# piece, too.
PIECES = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[\s.,]|$)|[.,]+(?=\s|$)| ?\S+|\s+(?!\S)|\s+")
WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# Characters that Python's \s and the tokenizer's differ on.
UNSURE = re.compile("[\x1c-\x1f]")
# First bytes of white space beyond ASCII, and those characters: such texts are cut by PIECES.
ODD = np.zeros(256, dtype=bool)
ODD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
# Bytes of the letters that PIECES knows. The second bytes of the two signs among them, × and ÷,
# are letters' second bytes elsewhere only after C3, so a text with C3 97 or C3 B7 is odd as well.
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = True
# Signs that end a run of letters for the splitter.
STOP = np.zeros(256, dtype=bool)
STOP[[b for b in range(33, 127) if not chr(b).isalpha()]] = True


def piece_bounds(buf: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of the pieces in a batch of plain texts; text d ends at ends[d]. They are those of
    PIECES, but letters at the start of a run end a piece before any ASCII sign or digit."""
    n = len(buf)
    white = BLANK[buf]
    first = np.zeros(n + 1, dtype=bool)  # first bytes of texts
    first[0] = True
    first[ends] = True
    before = np.concatenate(([True], white[:-1]))
    head = ~white & (before | first[:n])  # first bytes of runs that are not white
    start = first[:n] | head  # a run of white space starts a piece, as its last blank may, too
    start[1:] |= white[1:] & ~white[:-1]
    # the last of a white run before a word: a blank goes to the word, another is a piece of its own
    at = np.flatnonzero(head & ~first[:n])
    start[at - 1] = True
    start[at[buf[at - 1] == 32]] = False
    # letters from the start of a run up to a sign
    at = np.flatnonzero(head)
    if len(at):
        plain = LETTER[buf]
        stops = np.flatnonzero(~plain | first[:n])  # where a run of letters is over
        after = np.searchsorted(stops, at + 1)
        over = stops[np.minimum(after, len(stops) - 1)]
        ok = (after < len(stops)) & plain[at] & STOP[buf[over]] & ~first[over]
        start[over[ok]] = True
    return np.flatnonzero(start)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceEncoder:
    """Encodes whole texts piece by piece. Words repeat, so the tokenizer encodes each once: about
    CACHE_PIECES are held by their 64-bit hash, and a Python worker keeps them from task to task.
    Their ids lie in one table. A slot for each start of a hash tells the piece met there last, so
    most pieces of a batch are found by array lookups; the rest are looked up once each.
    A piece of letters is one word of the tokenizer's splitter and goes straight to its model."""

    kept: dict[str, PieceEncoder] = {}

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary need more than 16 planes")
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self._forget()

    def _forget(self) -> None:
        """Start with no piece held: piece i has the ids begin[i]:begin[i] + size[i] of the table."""
        self.held: dict[int, int] = {}
        self.table, self.used = np.zeros(1 << 16, dtype="<u2"), 0
        self.begin, self.size = np.zeros(1 << 14, dtype=np.int64), np.zeros(1 << 14, dtype=np.int64)
        # An empty slot holds a key that belongs to its neighbour, so no piece is found there.
        self.slot_key = (np.arange(1 << SLOT_BITS, dtype=np.uint64) ^ np.uint64(1)) << np.uint64(64 - SLOT_BITS)
        self.slot_piece = np.zeros(1 << SLOT_BITS, dtype=np.int64)

    @staticmethod
    def _grown(values: np.ndarray, n: int) -> np.ndarray:
        if n <= len(values):
            return values
        out = np.zeros(max(n, 2 * len(values)), dtype=values.dtype)
        out[: len(values)] = values
        return out

    def _learn(self, keys: list[int], pieces: list[bytes]) -> np.ndarray:
        """Encode new pieces of plain texts and hold them; returns their numbers."""
        joined = b"".join(pieces)
        ends = np.cumsum([len(x) for x in pieces])
        starts = ends - [len(x) for x in pieces]
        buf = np.frombuffer(joined, dtype=np.uint8)
        other = ~LETTER[buf]
        blank = buf[starts] == 32
        word = (np.add.reduceat(other, starts, dtype=np.int64) == blank) & (ends - starts > blank)
        shown, tokenize = joined.decode("latin-1").translate(self.letters), self.model.tokenize
        ids, size = [], []
        for piece, a, b, plain in zip(pieces, starts.tolist(), ends.tolist(), word.tolist()):
            if plain:
                found = [t.id for t in tokenize(shown[a:b])]
            else:
                found = self.tokenizer.encode(piece.decode("utf-8"), add_special_tokens=False).ids
            ids += found
            size.append(len(found))
        first, n = len(self.held), len(self.held) + len(keys)
        self.table = self._grown(self.table, self.used + len(ids))
        self.table[self.used : self.used + len(ids)] = ids
        self.begin, self.size = self._grown(self.begin, n), self._grown(self.size, n)
        self.size[first:n] = size
        self.begin[first:n] = self.used + np.cumsum(size) - size
        self.used += len(ids)
        self.held.update(zip(keys, range(first, n)))
        return np.arange(first, n)

    def _numbers(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The number of each piece of a batch; new ones are encoded."""
        keys = span_hashes(buf, start, stop)
        slot = (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        numbers = self.slot_piece[slot]
        missed = np.flatnonzero(self.slot_key[slot] != keys)
        if not len(missed):
            return numbers
        some, one, which = np.unique(keys[missed], return_index=True, return_inverse=True)
        found = np.fromiter((self.held.get(k, -1) for k in some.tolist()), dtype=np.int64, count=len(some))
        new = np.flatnonzero(found < 0)
        if len(new):
            at, whole = missed[one[new]], buf.tobytes()
            pieces = [whole[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist())]
            found[new] = self._learn(some[new].tolist(), pieces)
        # Sorted keys share a slot only with their neighbours: the last of each slot stays.
        place = (some >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        last = np.flatnonzero(np.append(place[1:] != place[:-1], True))
        self.slot_key[place[last]], self.slot_piece[place[last]] = some[last], found[last]
        numbers[missed] = found[which]
        return numbers

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        if WORD.fullmatch(piece):
            tokens = self.model.tokenize("".join(map(self.letters.__getitem__, piece)))
            return struct.pack(f"<{len(tokens)}H", *[t.id for t in tokens])
        return self._ids(piece.decode("utf-8"))

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian 16-bit integers."""
        if not text:
            return b""
        if UNSURE.search(text) or self.special and self.special.search(text):
            return self._ids(text)
        return b"".join([self._piece(p.encode("utf-8")) for p in PIECES.findall(text)])

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text. Plain texts are cut together."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        plain = [bool(r) and not (self.special and self.special.search(t) or b"\xc3\x97" in r or b"\xc3\xb7" in r)
                 for t, r in zip(texts, raw)]
        buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        odd = np.flatnonzero(ODD[buf])
        for d in np.unique(np.searchsorted(ends, odd, side="right")):
            plain[d] = False
        out = [np.frombuffer(self.encode(t), dtype="<u2") if not p else None for t, p in zip(texts, plain)]
        kept = [r for r, p in zip(raw, plain) if p]
        if not kept:
            return out
        if len(kept) < len(raw):
            buf, ends = np.frombuffer(b"".join(kept), dtype=np.uint8), np.cumsum([len(r) for r in kept], dtype=np.int64)
        start = piece_bounds(buf, ends)
        stop = np.concatenate((start[1:], [len(buf)]))
        if len(self.held) > CACHE_PIECES or self.used > CACHE_IDS:
            self._forget()
        numbers = self._numbers(buf, start, stop)
        each = self.size[numbers]
        last = np.cumsum(each)
        ids = self.table[np.repeat(self.begin[numbers] - (last - each), each) + np.arange(last[-1])]
        cuts = iter(np.split(ids, last[np.searchsorted(start, ends) - 1][:-1]))
        return [next(cuts) if o is None else o for o in out]


class WaveletMatrix:
    """Bit-planes (packed, least bit first), counts of ones before each block, zeros per plane."""

    def __init__(self, n: int, planes: list[bytes], ranks: list[bytes], zeros: list[int]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, dtype=np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, dtype="<u4") for r in ranks]

    @staticmethod
    def build(ids: np.ndarray, bits: int = 16) -> WaveletMatrix:
        planes, ranks, zeros = [], [], []
        for k in range(bits - 1, -1, -1):
            one = (ids >> np.uint16(k)) & np.uint16(1) == 1
            packed = np.packbits(one, bitorder="little")
            padded = np.zeros(-(-len(packed) // 64) * 64, dtype=np.uint8)
            padded[: len(packed)] = packed
            counts = np.bitwise_count(padded).reshape(-1, 64).sum(axis=1, dtype=np.uint32)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate(([0], np.cumsum(counts))).astype("<u4").tobytes())
            ids = np.concatenate((ids[~one], ids[one]))
            zeros.append(len(ids) - int(one.sum()))
        return WaveletMatrix(len(ids), planes, ranks, zeros)

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i >> 3]) >> (i & 7) & 1

    def _rank1(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK_BITS
        rest = self.planes[plane][block * 64 : i >> 3]
        count = int(self.ranks[plane][block]) + int(np.bitwise_count(rest).sum())
        return count + (int(self.planes[plane][i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(len(self.planes)):
            bit, ones = self._bit(plane, i), self._rank1(plane, i)
            value = value << 1 | bit
            i = self.zeros[plane] + ones if bit else i - ones
        return value

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        """Where the occurrences of an id among the first `stop` ids end up below the last plane."""
        if token >> len(self.planes):
            return 0, 0
        a, b = 0, stop
        for plane in range(len(self.planes)):
            x, y = self._rank1(plane, a), self._rank1(plane, b)
            if token >> (len(self.planes) - 1 - plane) & 1:
                a, b = self.zeros[plane] + x, self.zeros[plane] + y
            else:
                a, b = a - x, b - y
        return a, b

    def rank(self, token: int, stop: int) -> int:
        """Occurrences of an id among the first `stop` ids."""
        a, b = self._range(token, stop)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, plane: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) bit of that kind in a plane, by the rank directory."""
        ones = self.ranks[plane].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK_BITS, self.n) - ones
        block = int(np.searchsorted(before, j, side="right")) - 1
        inside = np.unpackbits(self.planes[plane][block * 64 : block * 64 + 64], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(inside == bit)[j - int(before[block])])

    def select(self, token: int, j: int) -> int:
        """Position of the j-th occurrence (from 0) of an id."""
        a, b = self._range(token, self.n)
        if not 0 <= j < b - a:
            raise IndexError(j)
        i = a + j
        for plane in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - plane) & 1
            i = self._select_bit(plane, bit, i - self.zeros[plane] if bit else i)
        return i

    def positions(self, token: int) -> list[int]:
        return [self.select(token, j) for j in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids in order, plane by plane from the lowest bit."""
        ids = np.zeros(self.n, dtype=np.uint16)
        for k, plane in enumerate(reversed(range(len(self.planes)))):
            one = np.unpackbits(self.planes[plane], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(ids)
            above[~one] = ids[: self.zeros[plane]]
            above[one] = ids[self.zeros[plane] :]
            above |= one.astype(np.uint16) << np.uint16(k)
            ids = above
        return ids


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text of docs (doc_id, text) and write the shards below path.

    A null or empty text gives the end id alone. Rows without doc_id come first; rows with equal
    doc_id follow each other by their text's hash. A shard closes after the document that takes it
    to shard_tokens, so it holds whole documents and a task holds one shard in memory. An empty
    table gives no shard.
    """

    def run(batches):
        encoder, end = PieceEncoder.of(tokenizer), np.array([end_id], dtype="<u2")
        place, seq = TaskContext.get().partitionId(), 0
        held, ids, lengths = [], [], []

        def shard():
            m = WaveletMatrix.build(np.concatenate(held))
            return pa.RecordBatch.from_arrays(
                [pa.array([place], pa.int32()), pa.array([seq], pa.int32()), pa.array([m.n], pa.int64()),
                 pa.array([[p.tobytes() for p in m.planes]], pa.list_(pa.binary())),
                 pa.array([[r.tobytes() for r in m.ranks]], pa.list_(pa.binary())),
                 pa.array([m.zeros], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([lengths], pa.list_(pa.int64()))],
                names=["part", "seq", "n_tokens", "planes", "ranks", "zeros", "doc_ids", "lengths"])

        total = 0
        for part in slices(batches, SLICE):
            for doc_id, encoded in zip(part.column(0).to_pylist(), encoder.encode_batch(part.column(1).to_pylist())):
                held += [encoded, end]
                ids.append(doc_id)
                lengths.append(len(encoded) + 1)
                total += lengths[-1]
                if total >= shard_tokens:
                    yield shard()
                    seq, total, held, ids, lengths = seq + 1, 0, [], [], []
        if ids:
            yield shard()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = rows.withColumn("tie", F.xxhash64("text"))
    ordered = order.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    (ordered.mapInArrow(run, SHARD_SCHEMA).write.option("maxRecordsPerFile", 1).option("compression", "zstd").parquet(path))


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def _per_shard(shards: DataFrame, columns: list[str], schema: str, job: Callable) -> DataFrame:
    """Rows that job(row, matrix) yields for each shard, as a dict of columns."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                matrix = WaveletMatrix(row["n_tokens"], row.pop("planes"), row.pop("ranks"), row["zeros"])
                for out in job(row, matrix):
                    yield pa.RecordBatch.from_pydict(out, schema=_arrow(schema))

    return shards.select("part", "seq", "n_tokens", "planes", "ranks", "zeros", *columns).mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, first): ids of all shards before each one. The table has a row per shard."""
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return sizes.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "seq", (F.col("base") + F.col("own")).alias("first"))


def decode_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the shards."""

    def job(row, matrix):
        ids, ends = matrix.decode().astype("<u4"), np.cumsum(row["lengths"])
        starts = ends - row["lengths"]
        yield {"part": [row["part"]] * len(ends), "seq": [row["seq"]] * len(ends), "doc_id": row["doc_ids"],
               "offset": starts.tolist(), "n_tokens": row["lengths"],
               "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]}

    shards = read_shards(spark, path)
    found = _per_shard(shards, ["doc_ids", "lengths"], "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long", job)
    return found.join(shard_starts(shards), ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each id over all shards, by rank alone."""

    def job(row, matrix):
        yield {"token": tokens, "n": [matrix.count(t) for t in tokens]}

    found = _per_shard(read_shards(spark, path), [], "token long, n long", job)
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(doc_id, position): each occurrence of an id and its place in its document, by select alone."""

    def job(row, matrix):
        at = np.array(matrix.positions(token), dtype=np.int64)
        starts = np.cumsum([0, *row["lengths"]])
        doc = np.searchsorted(starts, at, side="right") - 1
        yield {"doc_id": [row["doc_ids"][d] for d in doc], "position": (at - starts[doc]).tolist()}

    return _per_shard(read_shards(spark, path), ["doc_ids", "lengths"], "doc_id long, position long", job)
