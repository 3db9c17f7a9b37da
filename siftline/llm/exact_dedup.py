"""Exact deduplication against a minimal perfect hash of historical digests.

The distinct digests of earlier deliveries are dealt into buckets by their first bytes. Each bucket
is one row of the index: a minimal perfect hash, and in its slots the full digest, the winner (the
largest ``doc_id`` so far) and the number of rows. New digests are pre-aggregated, looked up in their
bucket and compared byte for byte with the slot; members raise the slot's winner and count,
nonmembers form groups of their own. Digests are uniform and distinct, and there are as many buckets as
the larger of both deliveries needs, so buckets are of even, bounded size whatever the sizes of the
groups of copies or of the history.

Rows: null counts as the empty text; the largest ``doc_id`` of a group stays, null ids only where the
group has no other; of rows with equal id and text one stays; an empty table gives no row, and an
empty history makes all digests nonmembers. Extra columns are not read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import U64, mix
from .shared import join_groups, keep_rows, materialise

BUCKET_DIGESTS = 1 << 14
_NULL = np.iinfo(np.int64).min
_TRIES = 64


def digest(text: Column | str) -> Column:
    """SHA-256 of the text with A-Z lower-cased, 32 bytes."""
    own = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.translate(F.coalesce(own, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256))


def _keys(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three 64-bit numbers from bytes 8 to 31 of each digest (n, 32)."""
    x = np.ascontiguousarray(digests[:, 8:]).view("<u8")
    return x[:, 0].astype(U64), x[:, 1].astype(U64), x[:, 2].astype(U64) | U64(1)


def _slot(base: np.ndarray, step: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(base + displacement.astype(U64) * step) % U64(n)).astype(np.int64)


class PerfectHash:
    """Maps each of n distinct digests to its own slot of n; other digests to some slot.

    Digests are dealt to about n / 4 groups. From the largest group down, a displacement is sought
    that puts its digests on free slots; a group of one takes a free slot directly (below zero).
    """

    def __init__(self, n: int, displacements: np.ndarray):
        self.n, self.displacements = n, displacements

    @classmethod
    def build(cls, digests: np.ndarray) -> PerfectHash:
        n = len(digests)
        groups = max(1, n // 4)
        first, base, step = _keys(digests)
        group = (first % U64(groups)).astype(np.int64)
        order, sizes = np.argsort(group, kind="stable"), np.bincount(group, minlength=groups)
        ends = np.cumsum(sizes)
        free = np.ones(n, dtype=bool)
        displacements = np.zeros(groups, np.int64)
        by_size = np.argsort(-sizes, kind="stable")
        for g in by_size[sizes[by_size] > 1].tolist():
            own = order[ends[g] - sizes[g] : ends[g]]
            at = 0
            while True:
                tried = _slot(base[own][:, None], step[own][:, None], at + np.arange(_TRIES)[None, :], n)
                good = free[tried].all(axis=0)
                ordered = np.sort(tried, axis=0)
                good &= (ordered[1:] != ordered[:-1]).all(axis=0)
                if good.any():
                    break
                at += _TRIES
            k = int(np.argmax(good))
            displacements[g] = at + k
            free[tried[:, k]] = False
        singles = by_size[sizes[by_size] == 1]
        displacements[singles] = -1 - np.flatnonzero(free)[: len(singles)]
        return cls(n, displacements)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        first, base, step = _keys(digests)
        d = self.displacements[(first % U64(len(self.displacements))).astype(np.int64)]
        return np.where(d < 0, -1 - d, _slot(base, step, np.maximum(d, 0), self.n))


def _as_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(int(_NULL)).to_numpy()


_INDEX = "bucket long, n long, displacements binary, digests binary, winners binary, counts binary"


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket from distinct historical digests: ``history`` has digest, winner, n."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        digests = _as_rows(table["digest"])
        own = PerfectHash.build(digests)
        order = np.argsort(own.slots(digests))
        values = [[key[0].as_py()], [own.n], [own.displacements.astype("<i8").tobytes()], [digests[order].tobytes()], [_ids(table["winner"])[order].astype("<i8").tobytes()], [table["n"].to_numpy()[order].astype("<i8").tobytes()]]
        return pa.table(dict(zip(("bucket", "n", "displacements", "digests", "winners", "counts"), values, strict=True)))

    return history.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInArrow(build, _INDEX)


def _bucket(buckets: int) -> Column:
    return F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long") % buckets


_GROUPS = "digest binary, keep_id long, group_size long, historical boolean"


def look_up(index: DataFrame, new: DataFrame, buckets: int) -> DataFrame:
    """Groups of all digests, historical or in ``new`` (distinct digest, winner, n): digest, keep_id, group_size, historical."""

    def join(key: tuple, stored: pa.Table, fresh: pa.Table) -> pa.Table:
        digests, winners, counts = _as_rows(fresh["digest"]), _ids(fresh["winner"]), fresh["n"].to_numpy()
        out = []
        member = np.zeros(len(digests), dtype=bool)
        for row in stored.to_pylist():
            slots = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
            best, total = np.frombuffer(row["winners"], "<i8").copy(), np.frombuffer(row["counts"], "<i8").copy()
            at = PerfectHash(row["n"], np.frombuffer(row["displacements"], "<i8")).slots(digests)
            member = (slots[at] == digests).all(axis=1)
            best[at[member]] = np.maximum(best[at[member]], winners[member])
            total[at[member]] += counts[member]
            out.append((slots, best, total, True))
        out.append((digests[~member], winners[~member], counts[~member], False))
        parts = [pa.table({"digest": pa.array([x.tobytes() for x in d], pa.binary()), "keep_id": pa.array(w, pa.int64(), mask=w == _NULL), "group_size": pa.array(c, pa.int64()), "historical": pa.array([h] * len(d), pa.bool_())}) for d, w, c, h in out]
        return pa.concat_tables(parts)

    fresh = new.withColumn("bucket", _bucket(buckets))
    return index.groupBy("bucket").cogroup(fresh.groupBy("bucket")).applyInArrow(join, _GROUPS)


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("n").alias("n"))


def group_digests(history: DataFrame, new: DataFrame) -> DataFrame:
    """Groups of two deliveries of (digest, doc_id, n)."""
    known, fresh = materialise(_groups(history), "history"), materialise(_groups(new), "new")
    buckets = max(1, -(-max(known.count(), fresh.count()) // BUCKET_DIGESTS))
    index = materialise(build_index(known, buckets), "index")
    return look_up(index, fresh, buckets)


def _delivered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (digest, doc_id) with their numbers, and the groups. Half of the ids, drawn by hash, are the historical delivery."""
    rows = materialise(docs.select("doc_id", digest("text").alias("digest")).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")), "digests")
    earlier = F.xxhash64("doc_id") % 2 == 0
    return rows, materialise(group_digests(rows.filter(earlier), rows.filter(~earlier)), "groups")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each document, dropped ones too."""
    rows, groups = _delivered(docs)
    out = join_groups(rows, groups, "digest", "group_size").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_last_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    rows, groups = _delivered(docs)
    kept = groups.select(F.col("keep_id").alias("doc_id"), F.col("digest").alias("key"))
    return keep_rows(docs, kept, digest("text"))
