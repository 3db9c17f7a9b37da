"""Contamination by a benchmark of any size: winnowed fingerprints of documents and items meet in shuffled joins.

1. Fingerprints of all documents meet the distinct fingerprints of the items; only their places in a document go on. Items
   of fewer words than a window have no fingerprint that is sure to be shared: windows of such sizes are met by hash.
2. Documents with such places give the windows around them, word for word; these meet the distinct windows of the items.
3. A document's windows become spans, and items come by the distinct windows that it has.

Everything is keyed by the digest of the text, so copies are one document until the end, and every join is on a hash, a
window or a digest; neither side passes through the driver, and nothing but the sizes of the short items, at most
twelve numbers, is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import text_chunks
from .decontam import Words, around, winnow
from .shared import join_groups, materialise, text_batches

SPANS = "struct<n_hit:long,spans:array<struct<first:int,end:int>>>"


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _item_windows(window: int, k: int):
    """size, words, h, item_id of each distinct window of an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in text_chunks(batch.column(1)):
                own = Words(buf, offsets)
                rows = []
                for i, (a, b) in enumerate(zip(own.begins[:-1].tolist(), own.begins[1:].tolist(), strict=True)):
                    size = min(window, b - a)
                    if size:
                        at = np.arange(a, b - size + 1)
                        rows += [(size, w, h, lo + i) for w, h in zip(_windows(own, at, size), own.windows(at, size).view(np.int64).tolist(), strict=True)]
                if rows:
                    size, words, h, item = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(size, pa.int32()), pa.array(words), pa.array(h, pa.int64()), batch.column(0).take(pa.array(item))], names=["size", "words", "h", "item_id"])

    return run


def _windows(words: Words, at: np.ndarray, size: int) -> list[str]:
    """The words of each window, joined by blanks, which no word has."""
    buf, starts, ends = words.buf.tobytes(), words.starts.tolist(), words.ends.tolist()
    return [b" ".join(buf[starts[j] : ends[j]] for j in range(i, i + size)).decode() for i in at.tolist()]


def _prints(window: int, k: int, with_places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, buf, offsets in text_chunks(batch.column(1)):
                own = Words(buf, offsets)
                places, prints = winnow(own.hashes, own.begins, window, k)
                text = own.texts_of(places)
                if not with_places:
                    yield pa.RecordBatch.from_arrays([_long(np.unique(prints))], names=["h"])
                    continue
                columns = [batch.column(0).take(pa.array(lo + text)), _long(prints), pa.array(np.full(len(places), window), pa.int32()), pa.array(places - own.begins[text], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "h", "size", "place"])

    return run


def _short_windows(sizes: list[int]):
    """digest, h, size, place of every window of the given sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, buf, offsets in text_chunks(batch.column(1)):
                own = Words(buf, offsets)
                for size in sizes:
                    at = np.arange(max(0, len(own.hashes) - size + 1))
                    text = own.texts_of(at)
                    good = at + size <= own.begins[text + 1]
                    at, text = at[good], text[good]
                    columns = [batch.column(0).take(pa.array(lo + text)), _long(own.windows(at, size)), pa.array(np.full(len(at), size), pa.int32()), pa.array(at - own.begins[text], pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["digest", "h", "size", "place"])

    return run


def _candidates(window: int, k: int):
    """digest, size, place, words of the windows that may be an item's; texts come with their places (size, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one text at a time: its windows are words, not numbers
                _, _, buf, offsets = next(text_chunks(batch.column(1).slice(i, 1), 1 << 62))
                own, found = Words(buf, offsets), batch.column(2)[i].as_py()
                rows: list[tuple[int, int, str]] = []
                for size in sorted({x["size"] for x in found}):
                    at = np.array(sorted(x["place"] for x in found if x["size"] == size), np.int64)
                    at = around(own, at, window, k) if size == window else at
                    rows += [(size, p, w) for p, w in zip(at.tolist(), _windows(own, at, size), strict=True)]
                if rows:
                    size, place, words = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(rows)), pa.array(size, pa.int32()), pa.array(place, pa.int32()), pa.array(words)], names=["digest", "size", "place", "words"])

    return run


def _joined_spans(found: Column) -> Column:
    """The union of spans (first, end) of each row, and how many words it has."""
    kind = pa.struct([("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = []
            for row in column:
                flat = row.values
                first, end = flat.field("first").to_numpy().astype(np.int64), flat.field("end").to_numpy().astype(np.int64)
                order = np.argsort(first, kind="stable")
                first, reach = first[order], np.maximum.accumulate(end[order])
                heads = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
                ends = reach[np.append(heads[1:], len(first)) - 1]
                out.append({"n_hit": int((ends - first[heads]).sum()), "spans": [{"first": a, "end": b} for a, b in zip(first[heads].tolist(), ends.tolist(), strict=True)]})
            yield pa.array(out, type=kind)

    return F.arrow_udf(run, SPANS)(found)


def _word_counts(text: Column) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            own = [np.diff(Words(buf, offsets).begins) for _, _, buf, offsets in text_chunks(column)]
            yield pa.array(np.concatenate(own) if own else np.zeros(0, np.int64), pa.int64())

    return F.arrow_udf(run, "long")(text)


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """digest, n_hit, spans, item_ids (sorted) of the distinct texts of ``docs`` that hold a window of ``benchmark``."""
    text_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    windows = materialise(items.mapInArrow(_item_windows(window, k), "size int, words string, h long, item_id string").distinct(), "item-windows")
    prints = items.mapInArrow(_prints(window, k, False), "h long").distinct()
    texts = docs.select(_digest(F.col("text")).alias("digest"), "text")
    kind = "digest string, h long, size int, place int"
    met = texts.mapInArrow(_prints(window, k, True), kind).join(prints, "h", "left_semi")
    short = sorted(r.size for r in windows.filter(F.col("size") < window).select("size").distinct().collect())
    if short:
        hashes = windows.filter(F.col("size") < window).select("size", "h").distinct()
        met = met.unionByName(texts.mapInArrow(_short_windows(short), kind).join(hashes, ["size", "h"], "left_semi").select("digest", "h", "size", "place"))
    places = materialise(met.groupBy("digest").agg(F.collect_set(F.struct("size", "place")).alias("places")), "met")  # bounded by the words of a text
    one = texts.join(places, "digest").dropDuplicates(["digest"]).select("digest", "text", "places")
    found = one.mapInArrow(_candidates(window, k), "digest string, size int, place int, words string")
    known = windows.select("size", "words").distinct()
    hits = materialise(found.join(known, ["size", "words"], "left_semi"), "window-hits")
    ends = F.struct(F.col("place").alias("first"), (F.col("place") + F.col("size")).alias("end"))
    spans = hits.groupBy("digest").agg(F.collect_list(ends).alias("own")).select("digest", _joined_spans(F.col("own")).alias("x")).select("digest", "x.*")
    named = hits.select("digest", "size", "words").distinct().join(windows.select("size", "words", "item_id").distinct(), ["size", "words"]).select("digest", "item_id").distinct()
    ids = named.groupBy("digest").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return spans.join(ids, "digest")


def find_by_join(docs: DataFrame, benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, spans of each of ``docs``."""
    found = materialise(contaminated_texts(docs, benchmark, window, k), "contaminated")
    rows = materialise(docs.select("doc_id", _digest(F.col("text")).alias("digest"), _word_counts(F.col("text")).alias("n_words")), "words")
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).join(found, "digest", "left")
    empty = {"n_hit": F.lit(0).cast("long"), "item_ids": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<first:int,end:int>>")}
    groups = groups.select("digest", "copies", *[F.coalesce(n, x).alias(n) for n, x in empty.items()])
    return join_groups(rows, materialise(groups, "judged"), "digest", "copies").select("doc_id", "n_words", "n_hit", "item_ids", "spans")


def drop_by_join(docs: DataFrame, benchmark: DataFrame, window: int, k: int, is_contaminated) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; those that are go by the digests of their texts."""
    found = contaminated_texts(docs, benchmark, window, k)
    texts = docs.select(_digest(F.col("text")).alias("digest"), "text").join(found.select("digest", "n_hit"), "digest").dropDuplicates(["digest"])
    bad = materialise(texts.select("digest", "n_hit", _word_counts(F.col("text")).alias("n_words")).filter(is_contaminated(F.struct("n_hit", "n_words"))).select("digest"), "bad")
    name = "__sl_digest"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, _digest(F.col("text"))).join(bad.withColumnRenamed("digest", name), name, "left_anti").select(*docs.columns)
