"""First-fit decreasing packing of documents into fixed-length sequences.

Documents are encoded and cut into pieces of at most ``capacity`` ids. Each piece goes to a random
group of about ``GROUP_PIECES``; in each group, pieces in descending length go to the first sequence
with room, found in a tournament tree of the capacities, so a full piece is a sequence of its own.
Groups are independent. Their number comes from the rows and bytes of the table, which bound the
number of pieces, so a long document makes more groups, not larger ones. A piece's group is drawn from
its id, place, digest and the number of equal documents before it in its task: no source or repeated
row makes one group large, and a task that is run again draws the same.

Rows: a null text is empty (its only id is the end id); repeated rows and ids are packed each on its
own; null ids stay null; an empty table gives no piece. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U64, mix, text_chunks
from .shared import text_batches
from .tokens import BLOCK, default_vocabulary, encoder

CAPACITY = 2048
GROUP_PIECES = 4096


class CapacityTree:
    """A tournament tree over the free room of ``n`` sequences; each node holds the most room below it."""

    def __init__(self, n: int, capacity: int):
        self.leaves = 1 << max(0, (n - 1).bit_length())
        self.most = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Takes ``size`` from the first sequence with room: its number and the room it had."""
        most, node = self.most, 1
        if most[1] < size:
            raise ValueError("no sequence has room")
        while node < self.leaves:
            node *= 2
            if most[node] < size:
                node += 1
        had, found = most[node], node - self.leaves
        most[node] = had - size
        node //= 2
        while node:
            high = max(most[2 * node], most[2 * node + 1])
            if most[node] == high:
                break
            most[node] = high
            node //= 2
        return found, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each of the lengths, which must descend."""
    tree = CapacityTree(max(1, len(lengths)), capacity)
    got = [tree.place(n) for n in lengths.tolist()]
    return np.array([g[0] for g in got], dtype=np.int64), np.array([capacity - g[1] for g in got], dtype=np.int64)


_PIECES = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "group": pa.int64(), "ids": pa.binary()}


def cut_documents(docs: DataFrame, groups: int, end: int = 1, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = True, seed: int = 7) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, ids_crc32, doc_tokens, group, ids.

    ``ids`` is null unless ``with_ids``: little-endian unsigned 32-bit integers. A very long text is encoded as a whole, some 20
    times its bytes of memory. The group is drawn by id, content and, of equal rows, by how often a task has met them, so a lost
    task that runs again draws the same whatever the order of its rows; that takes some 100 bytes for each document of a task.
    """
    text_batches(docs.sparkSession)
    file = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, met = encoder(file), Counter()
        encode = own_encoder.encode
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            for lo, hi, buf, offsets in text_chunks(batch.column(1), BLOCK):
                ids, at = encode(buf, offsets, end)
                n = np.diff(at)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                first = np.cumsum(pieces) - pieces
                start = (np.arange(len(doc)) - first[doc]) * capacity
                length = np.minimum(capacity, n[doc] - start)
                view = memoryview(ids.astype("<u4")).cast("B")
                cuts = [view[4 * a : 4 * b] for a, b in zip((at[doc] + start).tolist(), (at[doc] + start + length).tolist(), strict=True)]
                crc = np.array([zlib.crc32(c) for c in cuts], np.int64)
                own = keys.slice(lo, hi - lo)
                with np.errstate(over="ignore"):
                    text = mix(own.fill_null(-1).to_numpy().astype(U64) * U64(0x9E3779B97F4A7C15) + (n.astype(U64) << U64(32)) + crc[first].astype(U64) + U64(seed))
                    again = np.zeros(len(n), np.int64)
                    for i, t in enumerate(text.tolist()):
                        again[i] = met[t]
                        met[t] += 1
                    drawn = mix(text[doc] + mix((start.astype(U64) << U64(24)) + again[doc].astype(U64)))
                values = [own.take(pa.array(doc)), start, length, crc, n[doc], (drawn % U64(groups)).astype(np.int64), [c.tobytes() for c in cuts] if with_ids else [None] * len(cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, _PIECES.values(), strict=True)], names=list(_PIECES))
        own_encoder.release()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group long, ids binary")


_PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _pack_group(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    sequence, offset = first_fit_decreasing(rows["length"].to_numpy())
    rows = rows.append_column("sequence_id", pa.array((rows["group"].to_numpy() << 32) + sequence)).append_column("offset", pa.array(offset))
    return rows.select([c.split()[0] for c in _PACKED.split(", ")])


def pack_documents(docs: DataFrame, end: int = 1, vocabulary: str | None = None, group_pieces: int = GROUP_PIECES, with_ids: bool = True) -> DataFrame:
    """One row per piece, with its place: sequence_id and offset (gapless from 0 in each sequence).

    ``with_ids=False`` leaves ``ids`` null, so that only lengths and digests are shuffled.
    """
    size = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    groups = max(1, -(-(size.rows + size.bytes // CAPACITY) // group_pieces))  # an id has a byte at least
    pieces = cut_documents(docs, groups, end, CAPACITY, vocabulary, with_ids)
    return pieces.groupBy("group").applyInArrow(_pack_group, _PACKED)
