"""Token-id files compressed with Re-Pair grammars.

A file set is a Parquet folder of shards. A shard holds about ``SHARD_IDS`` ids of consecutive
documents as one grammar: rounds of Re-Pair replace the most frequent adjacent id pairs by
nonterminals, never across the border of two documents, until no pair occurs ``LEAST`` times. The
rules, the expansion length of each rule and the place of each document in the compressed sequence
are stored, so one document, or one id of it, is decoded without the rest of its shard. A document is
never parted, so a very long one makes its shard as large as itself. Ids of ``FIRST_RULE`` or more are
refused.

Rows: null texts are empty documents (their only id is the end id); documents are in ascending
``doc_id`` order, null first, equal ids in the order of a hash of the text; repeated rows are kept,
each with its own start; an empty table gives no shard and no row. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesops import ragged, text_chunks
from .shared import new_path, text_batches
from .tokens import default_vocabulary, encoder

FIRST_RULE = 1 << 20  # ids are below it; symbols have 24 bits
SHARD_IDS = 1 << 20
RULES_A_ROUND = 1 << 14
LEAST = 4  # a pair that occurs less often is no rule
MOST_PARTS = 600_000
CHUNK = 1 << 20  # bytes of text; a shard ends behind such a chunk
BLOCK = 4 << 20  # bytes of text whose distinct parts are looked up at once: those of a whole batch
_SLOTS = 20

SHARD_SCHEMA = "part int, shard int, n_tokens long, doc_ids array<long>, doc_tokens array<int>, doc_symbols array<int>, rules binary, rule_lengths binary, symbols binary"


def _counts(a: np.ndarray, b: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many pairs each slot has, and the slot of each pair; those across a border have a slot beside, which counts none."""
    slot = ((a.astype(np.uint32) * np.uint32(0x9E3779B1) + b.astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(32 - _SLOTS)).astype(np.intp)
    slot[borders] = 1 << _SLOTS
    counts = np.bincount(slot, minlength=(1 << _SLOTS) + 1)
    counts[-1] = 0
    return counts, slot


def _frequent(a: np.ndarray, b: np.ndarray, borders: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(places of pairs, the number of each one's pair, one place of each pair, whether all that was found was taken).

    Of a slot with enough pairs, the pair that stands first in it is looked at.
    """
    counts, slot = _counts(a, b, borders)
    above = np.cumsum(np.bincount(np.minimum(counts, 1 << 14))[::-1])[::-1]  # slots with so many pairs or more
    floor = max(least, int(np.searchsorted(-above, -2 * RULES_A_ROUND)))
    own = np.flatnonzero(counts >= floor)
    number = np.full(len(counts), -1, np.int32)
    number[own] = np.arange(len(own), dtype=np.int32)
    number = number[slot]
    hits = np.flatnonzero(number >= 0)
    number = number[hits]
    first = np.zeros(len(own), np.int64)
    first[number[::-1]] = hits[::-1]
    pairs = (a.astype(np.int64) << 32) | b
    same = pairs[hits] == pairs[first][number]
    hits, number = hits[same], number[same]
    often = np.bincount(number, minlength=len(own))
    keep = often >= least
    whole = floor == least and keep.sum() <= RULES_A_ROUND
    if keep.sum() > RULES_A_ROUND:
        keep[np.argsort(-often, kind="stable")[RULES_A_ROUND:]] = False
    new = np.cumsum(keep) - 1
    some = keep[number]
    return hits[some], new[number[some]], first[keep], whole


def _frequent_among(a: np.ndarray, b: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for all pairs at the given ascending places, by exact counts."""
    _, first, number, often = np.unique((a[places].astype(np.int64) << 32) | b[places], return_index=True, return_inverse=True, return_counts=True)
    keep = often >= least
    some = keep[number]
    return places[some], (np.cumsum(keep) - 1)[number[some]], places[first[keep]]


def compress(ids: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts of the documents among them, rules as pairs, expansion lengths of the rules)."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < FIRST_RULE:
        raise ValueError(f"ids must be in 0 .. {FIRST_RULE - 1}")
    seq, starts = ids.astype(np.int32), np.asarray(starts, dtype=np.int64)
    rules = np.zeros((0, 2), np.int32)
    lengths = np.zeros(0, np.int64)
    newest, exact = 0, False  # newest: the first rule of the last round, where only pairs with its rules may have become frequent
    while len(seq) > 1:
        a, b = seq[:-1], seq[1:]
        borders = starts[(starts > 0) & (starts < len(seq))] - 1
        hits = np.zeros(0, np.int64)
        if newest:
            new = seq >= newest
            near = new[:-1] | new[1:]
            near[borders] = False
            hits, rule, first = _frequent_among(a, b, np.flatnonzero(near), least)
        elif not exact:
            hits, rule, first, whole = _frequent(a, b, borders, least)
        if not len(hits) and not exact:  # frequent pairs that stood behind rare ones in their slots
            counts, slot = _counts(a, b, borders)
            hits, rule, first = _frequent_among(a, b, np.flatnonzero((counts >= least)[slot]), least)
            whole = exact = True
        if not len(hits):
            break
        # leftmost first: of a run of overlapping pairs, every second is replaced
        new_run = np.concatenate([[True], np.diff(hits) > 1])
        heads = np.maximum.accumulate(np.where(new_run, hits, 0))
        even = (hits - heads) % 2 == 0
        own = np.stack([a[first], b[first]], axis=1)
        hits, rule = hits[even], rule[even]
        newest = FIRST_RULE + len(rules) if whole else 0
        stay = np.ones(len(seq), dtype=bool)
        stay[hits + 1] = False
        seq[hits] = FIRST_RULE + len(rules) + rule
        seq = seq[stay]
        starts = starts - np.searchsorted(hits + 1, starts)
        lengths = np.concatenate([lengths, _lengths_of(own.ravel(), lengths).reshape(-1, 2).sum(axis=1)])
        rules = np.concatenate([rules, own])
    return seq, starts, rules, lengths


def _lengths_of(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.ones(len(symbols), np.int64)
    high = symbols >= FIRST_RULE
    out[high] = lengths[symbols[high] - FIRST_RULE]
    return out


def _expansions(rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rules one after another, and where each rule begins."""
    flat = (FIRST_RULE + np.arange(len(rules))).astype(np.int32)
    while len(high := np.flatnonzero(flat >= FIRST_RULE)):
        pairs = rules[flat[high] - FIRST_RULE]
        width = np.ones(len(flat), np.int8)
        width[high] = 2
        flat = np.repeat(flat, width)
        at = high + np.arange(len(high))  # each pair before has made one place more
        flat[at], flat[at + 1] = pairs[:, 0], pairs[:, 1]
    return flat, np.cumsum(lengths) - lengths


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    flat, begins = _expansions(rules, lengths)
    pool = np.concatenate([flat, np.zeros(0, np.int32)])
    high = symbols >= FIRST_RULE
    # terminals stand behind the pool, so that one gather gives all ids
    place = np.empty(len(symbols), np.int64)
    place[high] = begins[symbols[high] - FIRST_RULE]
    place[~high] = len(pool) + np.arange(int((~high).sum()))
    return np.concatenate([pool, symbols[~high].astype(np.int32)])[ragged(place, _lengths_of(symbols, lengths))]


def id_at(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, k: int) -> int:
    """The k-th id of a sequence of symbols, by expansion lengths: only one path of the grammar is walked."""
    ends = np.cumsum(_lengths_of(symbols, lengths))
    at = int(np.searchsorted(ends, k, side="right"))
    symbol, k = int(symbols[at]), k - (int(ends[at - 1]) if at else 0)
    while symbol >= FIRST_RULE:
        left, right = (int(x) for x in rules[symbol - FIRST_RULE])
        n = int(lengths[left - FIRST_RULE]) if left >= FIRST_RULE else 1
        symbol, k = (left, k) if k < n else (right, k - n)
    return symbol


def _pack(symbols: np.ndarray) -> bytes:
    """Three planes of bytes, low first."""
    if symbols.max(initial=0) >> 24:
        raise ValueError("a shard has more rules than 24 bits can name")
    return symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int32)
    return planes[0] | (planes[1] << 8) | (planes[2] << 16)


class Shard:
    """One stored shard; documents are numbered from 0 in its order."""

    def __init__(self, doc_symbols, rules: bytes, rule_lengths: bytes, symbols: bytes):
        self.rules = np.frombuffer(rules, "<i4").reshape(-1, 2)
        self.lengths = np.frombuffer(rule_lengths, "<i4").astype(np.int64)
        self.symbols = _unpack(symbols)
        self.ends = np.cumsum(np.asarray(doc_symbols, dtype=np.int64))

    def all_ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.lengths)

    def _of(self, k: int) -> np.ndarray:
        return self.symbols[(self.ends[k - 1] if k else 0) : self.ends[k]]

    def document(self, k: int) -> np.ndarray:
        return expand(self._of(k), self.rules, self.lengths)

    def token(self, k: int, i: int) -> int:
        return id_at(self._of(k), self.rules, self.lengths, i)


def _build(vocabulary: str, end: int, shard_ids: int):
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int32())), ("doc_symbols", pa.list_(pa.int32())), ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("symbols", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, encode = TaskContext.get().partitionId(), 0, encoder(vocabulary, MOST_PARTS, BLOCK).encode
        keys: list = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard
            every, n = np.concatenate(ids), np.concatenate(sizes)
            symbols, starts, rules, lengths = compress(every, np.cumsum(n) - n)
            row = {"part": part, "shard": shard, "n_tokens": len(every), "doc_ids": list(keys), "doc_tokens": n, "doc_symbols": np.diff(np.append(starts, len(symbols))), "rules": rules.astype("<i4").tobytes(), "rule_lengths": lengths.astype("<i4").tobytes(), "symbols": _pack(symbols)}
            shard += 1
            keys.clear(), ids.clear(), sizes.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own, texts = batch.column(0).to_pylist(), batch.column(1)
            ((_, _, buf, offsets),) = text_chunks(texts, 1 << 62)
            got, at = encode(buf, offsets, end)
            for lo, hi, _, _ in text_chunks(texts, CHUNK):
                keys += own[lo:hi]
                ids.append(got[at[lo] : at[hi]])
                sizes.append(np.diff(at[lo : hi + 1]))
                held += len(ids[-1])
                if held >= shard_ids:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, end: int, vocabulary: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encodes the texts and writes the file set to ``path``, shards in ascending ``doc_id`` order."""
    text_batches(docs.sparkSession)
    run = _build(vocabulary or default_vocabulary(), end, shard_ids)
    ordered = docs.select("doc_id", "text").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Shard(row["doc_symbols"], row["rules"], row["rule_lengths"], row["symbols"]).all_ids().astype("<u4")
            n = np.asarray(row["doc_tokens"], dtype=np.int64)
            ends, view = np.cumsum(n), memoryview(ids).cast("B")
            crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * len(n), pa.int32()), pa.array([row["shard"]] * len(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """part, shard, base: the number of ids before each shard. Totals of parts come first, so no window runs over all shards."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path).select("part", "shard", "n_tokens")
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("own", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    return shards.join(parts, "part").select("part", "shard", (F.col("part_base") + F.col("own")).alias("base"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    rows = shards.mapInArrow(_digests, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(read_index(spark, path), ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of the named documents; shards without them are skipped and no other document is decoded."""
    wanted = set(doc_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["doc_symbols"], row["rules"], row["rule_lengths"], row["symbols"])
                found = [(d, shard.document(k)) for k, d in enumerate(row["doc_ids"]) if d in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    named = F.array(*[F.lit(int(d)).cast("long") for d in doc_ids]) if doc_ids else F.array().cast("array<long>")
    return spark.read.schema(SHARD_SCHEMA).parquet(path).filter(F.arrays_overlap("doc_ids", named)).mapInArrow(run, "doc_id long, ids array<int>")


def token_files(docs: DataFrame, end: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Writes the file set of ``docs`` to the shared folder and reads its digests back."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_token_files(docs, path, end, vocabulary)
    return read_digests(spark, path)
