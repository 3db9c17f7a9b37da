"""Benchmark decontamination by winnowing.

Fingerprints of a text are the hashes of ``K`` consecutive words that are least in some run of
``window - K + 1`` of them, so two texts that share ``window`` words share a fingerprint at the same
place of the span. Fingerprints of the documents are joined with those of the benchmark items; every
window of words around a shared one is looked up among the items' windows and compared byte by byte,
and windows that overlap are extended to one span. An item of fewer words counts where all its words occur in order.

A benchmark of at most ``PAGE_BYTES`` is broadcast as one page; a larger one is joined by shuffles (``decontam_join``), with
the same result, and passes neither the driver nor a worker as a whole. Windows are looked up by distinct
hash, so repeated words or passages on either side do not multiply. ``contamination`` as a column deals what it is given into
pages and is meant for benchmarks of a few.

Rows: a null text, or one without words, has no words and is not contaminated; a null item has no
window; items that repeat an ``item_id`` count once; an empty benchmark hits nothing. Repeated rows
give repeated results. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import ALNUM, LOWER, U64, mix, ngram_hashes, ragged, segment, span_hashes, text_chunks
from .shared import give_back, text_batches

K = 5
WINDOW = 13
PAGE_BYTES = 4 << 20
PASS_BYTES = 32 << 20  # of documents for each time that a worker goes through several pages
_SLICE = 1 << 13  # windows that are compared byte by byte at once
_NONE = U64(0xFFFFFFFFFFFFFFFF)

RESULT = "n_words long, n_hit long, item_ids array<string>, spans array<struct<first:int,end:int>>"


def sliding(a: np.ndarray, width: int, op: Any) -> np.ndarray:
    """op over each ``width`` consecutive values."""
    n, power = len(a) - width + 1, 1
    if n < 1:
        return a[:0]
    part = a
    while power * 2 <= width:
        part = op(part[: len(part) - power], part[power:])
        power *= 2
    return op(part[:n], part[width - power : width - power + n])


def _within(hashes: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """n-gram hashes of several texts in a row; those across a border become _NONE."""
    grams = ngram_hashes(hashes, n)
    across = (begins[1:-1, None] - np.arange(1, n)).ravel()
    grams[across[(across >= 0) & (across < len(grams))]] = _NONE
    return grams


def winnow(hashes: np.ndarray, begins: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(places, fingerprints); equal least hashes of a run are all kept, so ties cannot part two texts."""
    grams = _within(hashes, begins, k)
    width = window - k + 1
    least = sliding(grams, width, np.minimum)
    if not len(least):
        return np.zeros(0, np.int64), grams[:0]
    pad = np.zeros(width - 1, U64)
    most = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
    places = np.flatnonzero((grams == most) & (grams != _NONE))
    return places, grams[places]


class Words:
    """Words of several texts in a row."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf = LOWER[buf]
        self.starts, self.ends, self.begins = segment(self.buf, offsets, ALNUM)
        self.hashes = span_hashes(self.buf, self.starts, self.ends)

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the ``size`` words from each of the places."""
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), U64)
            for j in range(size):
                h = h * U64(0x9FB21C651E98DF25) + self.hashes[at + j]
            return mix(h + U64(size))

    def texts_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, "right") - 1


def around(docs: Words, places: np.ndarray, window: int, k: int) -> np.ndarray:
    """Begins of all windows of one text that hold the fingerprint at one of the places."""
    text = docs.texts_of(places)
    lo = np.maximum(places - (window - k), docs.begins[text])
    hi = np.minimum(places, docs.begins[text + 1] - window) + 1
    some = lo < hi
    marks = np.zeros(len(docs.hashes) + 1, np.int32)
    np.add.at(marks, lo[some], 1)
    np.add.at(marks, hi[some], -1)
    return np.flatnonzero(np.cumsum(marks) > 0)


def _same_words(a: Words, at: np.ndarray, b: Words, to: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from each place of one are byte for byte those from the place of the other."""
    same = np.ones(len(at), bool)
    for lo in range(0, len(at), _SLICE):
        i, j = ((x[lo : lo + _SLICE, None] + np.arange(size)).ravel() for x in (at, to))
        n = a.ends[i] - a.starts[i]
        own = n == b.ends[j] - b.starts[j]
        i, j, n = i[own], j[own], n[own]
        odd = a.buf[ragged(a.starts[i], n)] != b.buf[ragged(b.starts[j], n)]
        own[np.flatnonzero(own)[np.searchsorted(np.cumsum(n), np.flatnonzero(odd), "right")]] = False
        same[lo : lo + _SLICE] = own.reshape(-1, size).all(axis=1)
    return same


class _Known:
    """Ascending distinct hashes, with a table of bits that turns most others away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.bits = np.zeros(1 << max(10, (16 * len(self.hashes)).bit_length()), dtype=bool)
        self.bits[self.hashes & U64(len(self.bits) - 1)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the given hashes that are known, and their numbers."""
        some = np.flatnonzero(self.bits[hashes & U64(len(self.bits) - 1)])
        if not len(self.hashes):
            return some[:0], some[:0]
        at = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        own = self.hashes[at] == hashes[some]
        return some[own], at[own]


class _Windows:
    """The distinct windows of one size: where each stands first, and which set of items has it."""

    def __init__(self, words: Words, at: np.ndarray, size: int, item: np.ndarray):
        hashes = words.windows(at, size)
        self.known = _Known(hashes)
        number = np.searchsorted(self.known.hashes, hashes)
        self.first = np.zeros(len(self.known.hashes), np.int64)
        self.first[number[::-1]] = at[::-1]
        # windows whose words differ from the first of their hash; a hash of 64 bits makes them rare to nonexistent
        odd = np.flatnonzero(~_same_words(words, at, words, self.first[number], size))
        self.others = [(int(number[k]), int(at[k]), int(item[k])) for k in odd.tolist()]
        own = np.ones(len(at), bool)
        own[odd] = False
        pairs = np.unique(number[own] * np.int64(item.max(initial=0) + 1) + item[own])
        number, item = np.divmod(pairs, np.int64(item.max(initial=0) + 1))
        cuts = np.searchsorted(number, np.arange(len(self.known.hashes) + 1))
        sets: dict[bytes, int] = {}
        self.set_of = np.array([sets.setdefault(item[x:y].tobytes(), len(sets)) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], np.int64)
        self.sets = [np.frombuffer(x, np.int64).tolist() for x in sets]


class Page:
    def __init__(self, items: list[tuple[Any, str]], window: int, k: int):
        _, _, buf, offsets = next(text_chunks(pa.array([t for _, t in items], pa.large_string()), 1 << 62))
        self.words, self.window, self.k = Words(buf, offsets), window, k
        self.ids = ["" if i is None else str(i) for i, _ in items]
        begins, n = self.words.begins, np.diff(self.words.begins)
        self.prints = _Known(winnow(self.words.hashes, begins, window, k)[1])
        self.sizes = {}
        for size in sorted({min(int(x), window) for x in n if x}):
            own = np.flatnonzero(n >= window) if size == window else np.flatnonzero(n == size)
            count = n[own] - size + 1
            self.sizes[size] = _Windows(self.words, ragged(begins[own], count), size, np.repeat(own, count))

    def scan(self, docs: Words, prints: tuple[np.ndarray, np.ndarray], found: dict[int, tuple[list[tuple[int, int]], set[str]]]) -> None:
        """Adds spans (of words in each text) and item ids to ``found``. ``prints`` are the winnowed fingerprints of ``docs``.

        Windows are looked up by distinct hash, so the time depends on the words of both sides, not on their pairs.
        """
        for size, own in self.sizes.items():
            if size == self.window:
                at = around(docs, prints[0][self.prints.find(prints[1])[0]], self.window, self.k)
            else:
                at = np.arange(max(0, len(docs.hashes) - size + 1))
                at = at[at + size <= docs.begins[docs.texts_of(at) + 1]]
            if not len(at):
                continue
            which, number = own.known.find(docs.windows(at, size))
            at = at[which]
            same = _same_words(docs, at, self.words, own.first[number], size)
            self._add(found, docs, at[same], size, own.set_of[number[same]], own.sets)
            for n, j, item in own.others:
                there = at[number == n]
                there = there[_same_words(docs, there, self.words, np.full(len(there), j), size)]
                self._add(found, docs, there, size, np.zeros(len(there), np.int64), [[item]])

    def _add(self, found, docs: Words, at: np.ndarray, size: int, sets: np.ndarray, items: list[list[int]]) -> None:
        """Ascending windows become spans, those that overlap or meet one span; equal sets of items count once a text."""
        if not len(at):
            return
        text = docs.texts_of(at)
        new = np.concatenate([[True], (at[1:] > at[:-1] + size) | (text[1:] != text[:-1])])
        heads = np.flatnonzero(new)
        ends = at[np.append(heads[1:], len(at)) - 1] + size
        base = docs.begins[text[heads]]
        for t, a, b in zip(text[heads].tolist(), (at[heads] - base).tolist(), (ends - base).tolist(), strict=True):
            found.setdefault(t, ([], set()))[0].append((a, b))
        for t, k in {*zip(text.tolist(), sets.tolist(), strict=True)}:
            found[t][1].update(self.ids[i] for i in items[k])


def _pages(benchmark: DataFrame, window: int, k: int, page_bytes: int) -> list:
    spark, pages, items, held = benchmark.sparkSession, [], [], 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        items.append((item_id, text or ""))
        held += len(items[-1][1])
        if held >= page_bytes:
            pages.append(spark.sparkContext.broadcast(Page(items, window, k)))
            items, held = [], 0
    if items:
        pages.append(spark.sparkContext.broadcast(Page(items, window, k)))
    return pages


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def contamination(text: Column | str, benchmark: DataFrame, window: int = WINDOW, k: int = K, page_bytes: int = PAGE_BYTES) -> Column:
    """A struct column for each text: n_words, n_hit, item_ids (sorted), spans of hit words (disjoint, ascending)."""
    text_batches(benchmark.sparkSession)
    pages = _pages(benchmark, window, k, page_bytes)
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))])

    def judged(columns: list[pa.Array]) -> Iterator[pa.Array]:
        """The results of some batches; each page is read once for all of them."""
        n_words = [np.zeros(len(c), np.int64) for c in columns]
        found: list[dict[int, tuple[list[tuple[int, int]], set[str]]]] = [{} for _ in columns]
        for number, page in enumerate(pages or [None]):
            for c, column in enumerate(columns):
                for lo, hi, buf, offsets in text_chunks(column):
                    docs = Words(buf, offsets)
                    n_words[c][lo:hi] = np.diff(docs.begins)
                    own: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
                    if page is not None:
                        page.value.scan(docs, winnow(docs.hashes, docs.begins, window, k), own)
                    for d, (spans, items) in own.items():
                        mine = found[c].setdefault(lo + d, ([], set()))
                        mine[0].extend(spans)
                        mine[1].update(items)
            if number or len(pages) > 1:
                del page._value
        for n, hits in zip(n_words, found, strict=True):
            rows = [{"n_words": x, "n_hit": 0, "item_ids": [], "spans": []} for x in n.tolist()]
            for d, (spans, items) in hits.items():
                whole = _union(spans)
                rows[d] |= {"n_hit": sum(b - a for a, b in whole), "item_ids": sorted(items), "spans": [{"first": a, "end": b} for a, b in whole]}
            yield pa.array(rows, type=kind)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held: list[pa.Array] = []
        for column in batches:
            held.append(column)
            if len(pages) < 2 or sum(c.nbytes for c in held) >= PASS_BYTES:
                yield from judged(held)
                held = []
        yield from judged(held)
        give_back()

    return F.arrow_udf(run, f"struct<{', '.join(x.replace(' ', ':', 1) for x in RESULT.split(', '))}>")(text)


def is_contaminated(found: Column) -> Column:
    """At least one word, and a twentieth of the words, is hit."""
    return (found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])


def _is_page(benchmark: DataFrame) -> bool:
    """Whether the benchmark is small enough to be broadcast: ``PAGE_BYTES`` of texts and ids."""
    size = benchmark.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + F.octet_length(F.coalesce(F.col("item_id").cast("string"), F.lit(""))) + 16).alias("n")).first()
    return (size.n or 0) <= PAGE_BYTES


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, spans, contaminated of each document.

    A benchmark of one page is broadcast; fingerprints of a larger one are joined with those of the documents by shuffles, with the same result.
    """
    if _is_page(benchmark):
        found = docs.select("doc_id", contamination("text", benchmark, window, k).alias("found")).select("doc_id", "found.*")
    else:
        found = decontam_join.find_by_join(docs, benchmark, window, k)
    return found.withColumn("contaminated", is_contaminated(F.struct("n_hit", "n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    if _is_page(benchmark):
        return docs.filter(~is_contaminated(contamination("text", benchmark, window, k)))
    return decontam_join.drop_by_join(docs, benchmark, window, k, is_contaminated)


from . import decontam_join  # noqa: E402 - it uses the words and fingerprints above
