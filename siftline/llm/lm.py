"""Language-model scores from a log-frequency Bloom filter.

Training counts words exactly, and pairs of words, over all training texts. Workers count pieces of
text into sorted arrays of hashes, which travel as blobs dealt by the high bits of the hash, so a word
that is a third of all tokens is one entry of each piece. A pair that occurs c times is put into the
filter once for each of the levels 1 .. 1 + floor(log2 c); a reader probes level after level until one
is missing and takes 2**(level - 1), the least such count. A word's pair count is smoothed with its
additive probability: (q(h, w) + mu * p(w)) / (c(h) + mu). As q never exceeds the true count, the
probabilities after any h add up to 1 at most, but for the filter's false positives: about 6 in 10,000
of the probed pairs that never occurred, which count as 1.

Counts and filter are dealt into blocks, one for each ``BLOCK_BYTES`` of training text. Up to
``BROADCAST_BYTES`` in all they are broadcast; beyond that the probes go to the blocks: each piece of
text asks every block once for its distinct words and pairs, and answers return to the piece. Both ways
give the same scores; nothing depends on the size of the corpus but the number of blocks. Words are
told apart by 64-bit hashes (XXH3), pairs by as many bits of one as make collisions rarer than false positives.

Rows: null texts are empty and have one token, the end; a null id counts as the empty text in the
choice of training rows; without training texts all counts are 0 and every score is finite; repeated
rows count and are scored each time; a very long text is a piece of its own. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .bytesops import LOWER, NONSPACE, U64, mix, segment, text_chunks
from .shared import give_back, materialise, text_batches

ADD = 0.1
MU = 200.0
BITS_AN_ENTRY = 16
PROBES = 8
BLOCK_BYTES = 8 << 20
BROADCAST_BYTES = 16 << 20
PIECE_BYTES = 8 << 20
WORDS, PAIRS, TEXTS = range(3)  # kinds of rows
_BUFFER = 1_000_000  # hashes that a counting worker gathers before it hands them on
_END, _START = U64(0x27D4EB2F165667C5), U64(0x165667B19E3779F9)


@dataclass(frozen=True)
class Sizes:
    """Of a model's blocks: their number as a power of two, and the bits of a pair's hash."""

    bits: int
    width: int

    @classmethod
    def of(cls, n_bytes: int) -> Sizes:
        """A text has at most one pair for every two bytes; 13 bits more than number these make collisions rarer than false positives."""
        return cls(max(0, -(-n_bytes // BLOCK_BYTES) - 1).bit_length(), min(64, max(24, (n_bytes // 2).bit_length() + 13)))


@dataclass
class Piece:
    """Consecutive texts as numbers of their distinct words; the end of a text is a word."""

    hashes: np.ndarray  # of the distinct words
    stream: np.ndarray  # the number of each token's word
    begins: np.ndarray  # first token of each text, and one place more

    @classmethod
    def of(cls, buf: np.ndarray, offsets: np.ndarray) -> Piece:
        low = LOWER[buf]
        starts, ends, begins = segment(low, offsets, NONSPACE)
        places = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(low[NONSPACE[low]])]).dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False)
        hashes = np.fromiter(map(xxh3_64_intdigest, known), U64, len(known))
        stream = np.insert(words.indices.to_numpy(), begins[1:], len(known))
        return cls(np.append(hashes, _END), stream.astype(np.int32), begins + np.arange(len(begins)))

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ascending distinct hashes of pairs, of ``width`` bits, the number of each token's pair (with the token before), and counts."""
        n = len(self.hashes) + 1  # the last number stands for the begin of a text
        before = np.empty(len(self.stream), np.int64)
        before[1:] = self.stream[:-1]
        before[self.begins[:-1]] = n - 1
        both, back, counts = np.unique(before * n + self.stream, return_inverse=True, return_counts=True)
        own = np.append(self.hashes, _START)
        with np.errstate(over="ignore"):
            hashes = mix(own[both // n] * U64(0x9FB21C651E98DF25) + own[both % n]) >> U64(64 - width)
        hashes, place, spread = _distinct(hashes, counts)
        return hashes, place[back], spread


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct hashes, the place of each given one among them, and sums of counts."""
    if not len(hashes):
        return hashes, np.zeros(0, np.int64), counts
    order = np.argsort(hashes)
    ordered = hashes[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.empty(len(hashes), np.int64)
    place[order] = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    return ordered[heads], place, np.add.reduceat(counts[order], heads)


def _write_numbers(x: np.ndarray) -> bytes:
    """How many, their width in bytes, and the compressed planes of their bytes."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(4, "little") + bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _read_numbers(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:4], "little"), data[4]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[5:], decompressed_size=n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(U64)


def _write_hashes(ascending: np.ndarray) -> bytes:
    return _write_numbers(np.diff(ascending, prepend=U64(0)))


def _read_hashes(data: bytes) -> np.ndarray:
    return np.cumsum(_read_numbers(data), dtype=U64)


def _block_of(kind: int, hashes: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The high bits of each hash."""
    return (hashes >> U64((64 if kind == WORDS else sizes.width) - sizes.bits)).astype(np.int64) if sizes.bits else np.zeros(len(hashes), np.int64)


def _by_block(kind: int, hashes: np.ndarray, sizes: Sizes) -> Iterator[tuple[int, int, int]]:
    """(block, first, end) of ascending hashes."""
    own, first = np.unique(_block_of(kind, hashes, sizes), return_index=True)
    return zip(own.tolist(), first.tolist(), np.append(first, len(hashes))[1:].tolist(), strict=True)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Piece]]:
    """Pieces of the last column of the batches, of about ``PIECE_BYTES`` or one longer text, and what the first column has for them."""
    held: list[pa.RecordBatch] = []

    def cut() -> Iterator[tuple[pa.Array, Piece]]:
        both = pa.Table.from_batches(held).combine_chunks()
        first, texts = both.column(0).combine_chunks(), both.column(both.num_columns - 1)
        for lo, hi, buf, offsets in text_chunks(texts, PIECE_BYTES):
            yield first.slice(lo, hi - lo), Piece.of(buf, offsets)

    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= PIECE_BYTES // 2:
            yield from cut()
            held = []
    if held:
        yield from cut()


class _Counter:
    def __init__(self):
        self.hashes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.held = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.counts.append(counts)
        self.held += len(hashes)
        if self.held > _BUFFER and len(self.hashes) > 1:
            h, _, c = _distinct(np.concatenate(self.hashes), np.concatenate(self.counts))
            self.hashes, self.counts, self.held = [h], [c], len(h)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        h, _, c = _distinct(np.concatenate([np.zeros(0, U64), *self.hashes]), np.concatenate([np.zeros(0, np.int64), *self.counts]))
        self.__init__()
        return h, c


_COUNTS = "kind int, block int, hashes binary, counts binary"


def _count(sizes: Sizes):
    def rows(kind: int, counter: _Counter) -> Iterator[pa.RecordBatch]:
        h, c = counter.take()
        own = [(b, _write_hashes(h[lo:hi]), _write_numbers(c[lo:hi])) for b, lo, hi in _by_block(kind, h, sizes)]
        if own:
            block, hashes, counts = zip(*own, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own), pa.int32()), pa.array(block, pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["kind", "block", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = _Counter(), _Counter()
        for _, piece in _pieces(batches):
            counters[WORDS].add(piece.hashes, np.bincount(piece.stream, minlength=len(piece.hashes)))
            hashes, _, counts = piece.pairs(sizes.width)
            counters[PAIRS].add(hashes, counts)
            for kind, counter in enumerate(counters):
                if counter.held > _BUFFER // 2:
                    yield from rows(kind, counter)
        for kind, counter in enumerate(counters):
            yield from rows(kind, counter)
        del counters
        give_back()

    return run


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def least_count(levels: np.ndarray) -> np.ndarray:
    """The least count that has so many levels; 0 for none."""
    return np.where(levels > 0, np.exp2(levels - 1.0), 0.0)


def _places(hashes: np.ndarray, level: int, k: int, sizes: Any) -> np.ndarray:
    with np.errstate(over="ignore"):
        g = mix(hashes ^ (U64(level) * U64(0xC2B2AE3D27D4EB4F)))
        return (((g & U64(0xFFFFFFFF)) + U64(k) * ((g >> U64(32)) | U64(1))) % sizes).astype(np.int64)


def build_filter(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bytes of one block of the filter."""
    levels = levels_of(counts)
    size = max(64, int(levels.sum()) * BITS_AN_ENTRY // 8 * 8)
    bits = np.zeros(size, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = hashes[levels >= level]
        for k in range(PROBES):
            bits[_places(own, level, k, U64(size))] = True
    return np.packbits(bits, bitorder="little")


def read_filter(body: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The level of each hash in the filter whose bytes begin at its start and are as many as its size."""
    out, live, level = np.zeros(len(hashes), np.int64), np.arange(len(hashes)), 1
    while len(live):
        for k in range(PROBES):
            place = _places(hashes[live], level, k, sizes[live].astype(U64) * U64(8))
            live = live[(body[starts[live] + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1]
        out[live] = level
        level += 1
    return out


_BLOCKS = "kind int, block int, hashes binary, body binary, total long, distinct long"


def _reduce(key: tuple, table: pa.Table) -> pa.Table:
    kind = key[0].as_py()
    h = np.concatenate([_read_hashes(x) for x in table["hashes"].to_pylist()])
    h, _, c = _distinct(h, np.concatenate([_read_numbers(x) for x in table["counts"].to_pylist()]).astype(np.int64))
    body = _write_numbers(c) if kind == WORDS else build_filter(h, c).tobytes()
    values = [kind, key[1].as_py(), _write_hashes(h) if kind == WORDS else b"", body, int(c.sum()), len(h)]
    return pa.table([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=[c.split()[0] for c in _BLOCKS.split(", ")])


class Store:
    """Blocks of word counts or of the filter, read by hash."""

    def __init__(self, kind: int, sizes: Sizes, blocks: list[tuple[int, bytes, bytes]]):
        self.kind, self.of = kind, sizes
        blocks = sorted(blocks)
        self.blocks = np.array([b for b, _, _ in blocks], np.int64)
        if kind == WORDS:
            self.hashes = np.concatenate([np.zeros(0, U64), *[_read_hashes(h) for _, h, _ in blocks]])
            self.body = np.concatenate([np.zeros(0, np.int64), *[_read_numbers(c).astype(np.int64) for _, _, c in blocks]])
        else:
            bodies = [np.frombuffer(c, np.uint8) for _, _, c in blocks]
            self.sizes = np.array([len(b) for b in bodies], np.int64)
            self.starts, self.body = np.cumsum(self.sizes) - self.sizes, np.concatenate([np.zeros(0, np.uint8), *bodies])

    def read(self, hashes: np.ndarray) -> np.ndarray:
        """Counts, or levels, of the hashes; 0 for those that are not stored."""
        known, own = (self.hashes, hashes) if self.kind == WORDS else (self.blocks, _block_of(PAIRS, hashes, self.of))
        if not len(known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        there = known[at] == own
        if self.kind == WORDS:
            return np.where(there, self.body[at], 0)
        out = np.zeros(len(hashes), np.int64)
        at = at[there]
        out[there] = read_filter(self.body, self.starts[at], self.sizes[at], hashes[there])
        return out


@dataclass
class Model:
    blocks: DataFrame  # kind, block, hashes, body
    sizes: Sizes
    n_bytes: int  # of training text
    total: int
    distinct: int
    texts: int
    mu: float
    stores: list = field(default_factory=list)  # broadcasts, where they are small enough

    @property
    def weights(self) -> tuple[int, int, int, float]:
        return self.total, self.distinct, self.texts, self.mu


def _scores(stream: np.ndarray, begins: np.ndarray, counts: np.ndarray, levels: np.ndarray, pair: np.ndarray, weights: tuple) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each text, from counts of its words and levels of its pairs."""
    total, distinct, texts, mu = weights
    c = counts[stream]
    base = (c + ADD) / (total + ADD * (distinct + 1))
    before = np.empty(len(c), np.float64)
    before[1:] = c[:-1]
    before[begins[:-1]] = texts
    together = np.minimum(least_count(levels)[pair], np.minimum(c, before))  # a pair occurs at most as often as its words
    smooth = (together + mu * base) / (before + mu)

    def per_text(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, begins[:-1])  # every text has a token

    return [np.diff(begins), per_text((c > 0).astype(np.int64)), per_text(np.log10(base)), per_text(np.log10(smooth))]


def fit(texts: DataFrame, mu: float = MU) -> Model:
    """Counts the column ``text`` of all rows of ``texts``; null is empty."""
    spark = texts.sparkSession
    text_batches(spark)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("texts")).first()
    sizes = Sizes.of(size.n)
    counted = texts.select("text").mapInArrow(_count(sizes), _COUNTS)
    blocks = materialise(counted.groupBy("kind", "block").applyInArrow(_reduce, _BLOCKS), "ngrams")
    words = F.col("kind") == WORDS
    sums = blocks.agg(F.sum(F.when(words, F.col("total"))).alias("n"), F.sum(F.when(words, F.col("distinct"))).alias("v"), F.sum(F.octet_length("hashes") + F.octet_length("body")).alias("bytes")).first()
    model = Model(blocks.select("kind", "block", "hashes", "body"), sizes, size.n, sums.n or 0, sums.v or 0, size.texts, mu)
    if (sums.bytes or 0) <= BROADCAST_BYTES:
        rows = model.blocks.collect()
        model.stores = [spark.sparkContext.broadcast(Store(kind, sizes, [(r.block, r.hashes, r.body) for r in rows if r.kind == kind])) for kind in (WORDS, PAIRS)]
    return model


_RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _batch(doc_ids: pa.Array, values: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), *[pa.array(v) for v in values]], names=[c.split()[0] for c in _RESULT.split(", ")])


def _score_here(stores: list, sizes: Sizes, weights: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, piece in _pieces(batches):
            hashes, pair, _ = piece.pairs(sizes.width)
            counts, levels = stores[WORDS].value.read(piece.hashes), stores[PAIRS].value.read(hashes)
            yield _batch(ids, _scores(piece.stream, piece.begins, counts, levels, pair, weights))

    return run


_ASKED = "piece long, kind int, block int, part int, asked binary, data binary"
_ASKED_TYPES = {"piece": pa.int64(), "kind": pa.int32(), "block": pa.int32(), "part": pa.int32(), "asked": pa.binary(), "data": pa.binary()}


def _ask(sizes: Sizes, parts: int):
    """Rows of the distinct words and of the pairs of each piece for each block (``asked``), and a row of the piece itself (``data``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for ids, piece in _pieces(batches):
            order = np.argsort(piece.hashes)  # words are numbered by their hashes from here
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            piece = Piece(piece.hashes[order], rank[piece.stream], piece.begins)
            rows, dealt = [], int(mix(np.array([number], U64))[0])  # numbers of many tasks end alike
            for kind, hashes in ((WORDS, piece.hashes), (PAIRS, piece.pairs(sizes.width)[0])):
                rows += [(number, kind, b, dealt % parts, _write_hashes(hashes[i:j]), None) for b, i, j in _by_block(kind, hashes, sizes)]
            with pa.BufferOutputStream() as sink:
                own = pa.record_batch([pa.array([x], pa.binary()) for x in (_write_numbers(np.diff(piece.begins)), _write_numbers(piece.stream))] + [pa.array([ids.to_pylist()], pa.list_(pa.int64()))], names=["lengths", "stream", "ids"])
                with pa.ipc.new_stream(sink, own.schema) as out:
                    out.write_batch(own)
                data = sink.getvalue().to_pybytes()
            rows.append((number, TEXTS, dealt % (1 << sizes.bits), 0, None, data))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _ASKED_TYPES.values(), strict=True)], names=list(_ASKED_TYPES))
            number += 1
        give_back()

    return run


def _answer(sizes: Sizes):
    """Counts and levels for what is asked of a block; hashes of words go back with them, and the pieces themselves pass through."""

    def run(key: tuple, asked: pa.Table, stored: pa.Table) -> pa.Table:
        kind = key[0].as_py()
        if kind == TEXTS or not asked.num_rows:
            return asked
        store = Store(kind, sizes, [(r["block"], r["hashes"], r["body"]) for r in stored.to_pylist()])
        given = asked["asked"].to_pylist()
        own = [_read_hashes(x) for x in given]
        values = np.split(store.read(np.concatenate(own)), np.cumsum([len(h) for h in own])[:-1])
        new = {"asked": given if kind == WORDS else [None] * len(given), "data": [_write_numbers(v) for v in values]}
        return pa.table([pa.array(new[c], t) if c in new else asked[c] for c, t in _ASKED_TYPES.items()], names=list(_ASKED_TYPES))

    return run


def _finish(sizes: Sizes, weights: tuple):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["block"]))
        with pa.ipc.open_stream(rows[-1]["data"]) as source:
            held = source.read_all()
        begins = np.concatenate([[0], np.cumsum(_read_numbers(held["lengths"][0].as_py()).astype(np.int64))])
        stream = _read_numbers(held["stream"][0].as_py()).astype(np.int32)
        hashes = np.concatenate([_read_hashes(r["asked"]) for r in rows if r["kind"] == WORDS])
        got = [np.concatenate([_read_numbers(r["data"]).astype(np.int64) for r in rows if r["kind"] == kind]) for kind in (WORDS, PAIRS)]
        _, pair, _ = Piece(hashes, stream, begins).pairs(sizes.width)
        return pa.Table.from_batches([_batch(held["ids"].chunk(0).flatten(), _scores(stream, begins, *got, pair, weights))])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) of each document."""
    text_batches(docs.sparkSession)
    own = docs.select("doc_id", "text")
    if model.stores:
        return own.mapInArrow(_score_here(model.stores, model.sizes, model.weights), _RESULT)
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()
    parts = max(1, -(-size.n // max(model.n_bytes, BLOCK_BYTES)))  # of a block's probes, where more is scored than was learnt
    asked = own.mapInArrow(_ask(model.sizes, parts), _ASKED)
    stored = model.blocks.select("kind", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "hashes", "body")
    keys = ["kind", "block", "part"]
    answers = asked.groupBy(*keys).cogroup(stored.groupBy(*keys)).applyInArrow(_answer(model.sizes), _ASKED)
    found = answers.groupBy("piece").applyInArrow(_finish(model.sizes, model.weights), _RESULT)
    return found.repartition("doc_id")  # scores are few bytes beside the pieces: dealt anew, they are written in few files


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 10, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learnt from the rows that are not held out."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("text"))
    found = score(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
