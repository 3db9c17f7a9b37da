"""Folded terms of whole Arrow batches.

Words are found in the bytes of a batch with tables, dictionary-encoded by Arrow, and only distinct words
are folded, so a frequent word costs an index. A slice of a batch is worked on at once, so that memory
is bounded by ``SLICE_BYTES`` or one longer text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOPWORDS, _deaccent, _fold_plural

SLICE_BYTES = 4 << 20
_STOP = frozenset(STOPWORDS)
_STOPS = pa.array(STOPWORDS, pa.large_string())
_WORD = regex.compile(r"[\p{L}\p{N}_]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ASCII = np.zeros(256, bool)
_ASCII[48:58] = _ASCII[97:123] = _ASCII[95] = True


@cache
def _letters() -> np.ndarray:
    """Whether a code point beyond ASCII is a letter or a number."""
    out = np.zeros(0x110000, bool)
    for m in _WORD.finditer("".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all spans, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


@lru_cache(1 << 17)
def _fold(word: str) -> tuple[str, ...]:
    low = word.lower()
    if low.isascii():
        if len(low) < 2 or low in _STOP:
            return ()
        low = _fold_plural(low) if low[-1] == "s" else low
        return (low,) if len(low) > 1 else ()
    out = []
    for part in _WORD.findall(low):  # lower case may bring marks that part a word
        if len(part) > 1 and part not in _STOP:
            part = _deaccent(part)
            out.append(_fold_plural(part) if part[-1] == "s" else part)
    return tuple(p for p in out if len(p) > 1)


@dataclass
class Terms:
    """The terms of some texts: ``ids`` name entries of ``terms``, those of text i from ``begins[i]`` on."""

    terms: pa.Array
    ids: np.ndarray
    begins: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.begins) - 1), np.diff(self.begins))

    def distinct(self) -> Terms:
        """Each term of a text once, where it stands first."""
        own = self.rows * np.int64(len(self.terms) + 1) + self.ids
        first = np.sort(np.unique(own, return_index=True)[1])
        return Terms(self.terms, self.ids[first], np.searchsorted(first, self.begins))

    def arrays(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.begins, pa.int32()), self.terms.take(pa.array(self.ids)))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _inside(buf: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to a letter, a number or an underscore."""
    inside = _ASCII[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        size = 2 + (buf[lead] >= 0xE0) + (buf[lead] >= 0xF0)
        code = buf[lead].astype(np.int64) & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
        for k in range(1, 4):
            more = size > k
            code[more] = code[more] << 6 | buf[lead[more] + k] & 0x3F
        good = _letters()[code]
        lead, size = lead[good], size[good]
        inside[spread(lead, size)] = True
    return inside


def _fold_all(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of distinct words, the numbers of their terms one word after another, and how many each word has.

    A word of ASCII letters that does not end in s is its own term or none, which Arrow tells; only the others are folded one by one.
    """
    plain = pc.and_(pc.string_is_ascii(words), pc.invert(pc.ends_with(words, "s")))
    own = pc.and_(plain, pc.and_(pc.greater_equal(pc.binary_length(words), 2), pc.invert(pc.is_in(words, _STOPS))))
    odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
    folded = [_fold(w) for w in words.take(pa.array(odd)).to_pylist()]
    own_at = np.flatnonzero(own.to_numpy(zero_copy_only=False))
    sizes = np.zeros(len(words), np.int64)
    sizes[own_at] = 1
    sizes[odd] = [len(x) for x in folded]
    first = np.cumsum(sizes) - sizes
    found = pa.concat_arrays([words.take(pa.array(own_at)), pa.array([t for x in folded for t in x], pa.large_string())]).dictionary_encode()
    flat = np.empty(int(sizes.sum()), np.int64)
    flat[np.concatenate([first[own_at], spread(first[odd], sizes[odd])])] = found.indices.to_numpy()
    return found.dictionary.cast(pa.string()), flat, sizes


def terms_of(column: pa.Array) -> Terms:
    """Terms of each text in order, repeats kept, stopwords and single characters dropped; null is empty."""
    buf, offsets = _flat(column.fill_null(""))
    low = _LOWER[buf]
    inside = _inside(low)
    before = np.zeros(len(low), bool)
    before[1:] = inside[:-1]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    starts = np.flatnonzero(inside & ~before)
    letters = np.concatenate([[0], np.cumsum(inside)])
    lengths = letters[np.append(starts[1:], len(low))] - letters[starts]
    places = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(low[inside])).dictionary_encode()
    terms, flat, sizes = _fold_all(words.dictionary.cast(pa.large_string()))
    index = words.indices.to_numpy()
    own = sizes[index]
    ids = flat[spread((np.cumsum(sizes) - sizes)[index], own)]
    begins = np.concatenate([[0], np.cumsum(own)])[np.searchsorted(starts, offsets)]
    return Terms(terms, ids, begins)


def slices(*columns: pa.Array) -> Iterator[list[pa.Array]]:
    """Consecutive rows of the columns with about ``SLICE_BYTES`` of text."""
    n = len(columns[0])
    sizes = np.cumsum(sum(pc.binary_length(c).fill_null(0).to_numpy().astype(np.int64) for c in columns))
    lo = 0
    while lo < n:
        reach = (sizes[lo - 1] if lo else 0) + SLICE_BYTES
        hi = min(n, max(lo + 1, int(np.searchsorted(sizes, reach, "right"))))
        yield [c.slice(lo, hi - lo) for c in columns]
        lo = hi


def arrow_column(kind: str, f: Callable[..., pa.Array], *columns: Column) -> Column:
    """A column of ``f`` over slices of the given columns."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            own = batch if isinstance(batch, tuple) else (batch,)
            parts = [f(*part) for part in slices(*own)]
            yield pa.concat_arrays(parts) if parts else f(*own)

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return run(batches)

    return F.arrow_udf(one if len(columns) == 1 else several, kind)(*columns)


def tokens(text: Column) -> Column:
    """Folded terms of a text in order, repeats kept, stopwords and single characters dropped."""
    return arrow_column("array<string>", lambda c: terms_of(c).arrays(), text)


def distinct_tokens(text: Column) -> Column:
    return arrow_column("array<string>", lambda c: terms_of(c).distinct().arrays(), text)


def token_counts(text: Column) -> Column:
    """A struct for each text: n_tokens, n_distinct."""

    def of(column: pa.Array) -> pa.Array:
        own = terms_of(column)
        return pa.StructArray.from_arrays([pa.array(np.diff(own.begins)), pa.array(np.diff(own.distinct().begins))], names=["n_tokens", "n_distinct"])

    return arrow_column("struct<n_tokens:long,n_distinct:long>", of, text)


def _hits(found: list[Terms], weights: list[int], chosen: Callable[[Terms], np.ndarray]) -> pa.Array:
    """dl and hits of each row; ``chosen`` has the indices of the wanted terms of a field."""
    n = len(found[0].begins) - 1
    base, rows, places, names = np.zeros(n, np.int64), [], [], []
    for own, weight in zip(found, weights, strict=True):
        at = chosen(own)
        row, size = own.rows[at], np.diff(own.begins)
        name = own.terms.take(pa.array(own.ids[at]))
        for _ in range(weight):
            rows.append(row)
            places.append(base[row] + at - own.begins[row])
            names.append(name)
            base = base + size
    rows, places = np.concatenate(rows), np.concatenate(places)
    order = np.lexsort((places, rows))
    counts = np.bincount(rows, minlength=n)
    hits = pa.StructArray.from_arrays([pa.array(places[order], pa.int32()), pa.concat_arrays(names).take(pa.array(order))], names=["pos", "term"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), hits)
    return pa.StructArray.from_arrays([pa.array(base, pa.int32()), lists], names=["dl", "hits"])


_HITS = "struct<dl:int,hits:array<struct<pos:int,term:string>>>"


def term_places(fields: list[tuple[Column, int]], wanted: list[str]) -> Column:
    """A struct for each row: dl, the number of terms of all fields, each repeated as often as its weight; hits, (pos, term) of the wanted terms in order."""
    weights, known = [w for _, w in fields], pa.array(wanted, pa.string())

    def chosen(own: Terms) -> np.ndarray:
        return np.flatnonzero(pc.is_in(own.terms, known).to_numpy(zero_copy_only=False)[own.ids])

    return arrow_column(_HITS, lambda *columns: _hits([terms_of(c) for c in columns], weights, chosen), *[c for c, _ in fields])


def row_term_places(fields: list[tuple[Column, int]], wanted: Column) -> Column:
    """As ``term_places``, each row with wanted terms of its own: a string of terms with blanks between them."""
    weights = [w for _, w in fields]

    def of(*columns: pa.Array) -> pa.Array:
        asked = [(i, t) for i, own in enumerate(columns[-1].to_pylist()) for t in (own or "").split()]
        row, term = np.array([i for i, _ in asked], np.int64), pa.array([t for _, t in asked], pa.string())

        def chosen(own: Terms) -> np.ndarray:
            number = pc.fill_null(pc.index_in(term, own.terms), -1).to_numpy()
            keys = (row * len(own.terms) + number)[number >= 0]
            return np.flatnonzero(np.isin(own.rows * np.int64(len(own.terms)) + own.ids, keys))

        return _hits([terms_of(c) for c in columns[:-1]], weights, chosen)

    return arrow_column(_HITS, of, *[c for c, _ in fields], wanted)
