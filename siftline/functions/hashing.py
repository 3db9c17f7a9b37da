"""64-bit FNV-1a over UTF-16 code units, and SimHash over token shingles, vectorised over a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .terms import Terms, arrow_column, terms_of

_OFFSET, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)
_SHINGLE = 3


class _Units:
    """The UTF-16 code units of many strings."""

    def __init__(self, strings: list[str]):
        units = [np.frombuffer(s.encode("utf-16-le", "surrogatepass"), "<u2") for s in strings]
        self.lengths = np.array([len(u) for u in units], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.concatenate([np.zeros(0, "<u2"), *units]).astype(np.uint64)

    def carry_on(self, state: np.ndarray, which: np.ndarray) -> np.ndarray:
        """The state of each hash behind the string that ``which`` names: one step for each position, over the strings that reach it."""
        order = np.argsort(-self.lengths[which], kind="stable")
        lengths, starts = self.lengths[which][order], self.starts[which][order]
        h = state[order]
        live = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), side="left")  # strings longer than j
        with np.errstate(over="ignore"):
            for j, n in enumerate(live.tolist()):
                h[:n] = (h[:n] ^ self.flat[starts[:n] + j]) * _PRIME
        out = np.empty_like(h)
        out[order] = h
        return out


def fnv1a64_of(strings: list[str]) -> np.ndarray:
    """Hashes of many strings at once."""
    return _Units(strings).carry_on(np.full(len(strings), _OFFSET, dtype=np.uint64), np.arange(len(strings)))


def fnv1a64(text: Column | str) -> Column:
    """The hash as a long with the same 64 bits; null stays null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            values = fnv1a64_of([x or "" for x in column.to_pylist()]).view(np.int64)
            yield pa.array(values, mask=np.asarray(column.is_null()))

    return F.arrow_udf(run, "long")(text)


def _shingle_hashes(own: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in a row, and how many each text has.

    A shingle's hash goes on from that of its first terms, so each distinct beginning is hashed once.
    """
    sizes = np.diff(own.begins)
    counts = np.where(sizes < _SHINGLE, sizes, sizes - _SHINGLE + 1)
    units = _Units([*own.terms.to_pylist(), " "])
    space, n = len(own.terms), np.int64(len(own.terms) + 1)
    one = units.carry_on(np.full(len(own.terms), _OFFSET, np.uint64), np.arange(len(own.terms)))
    short = np.repeat(sizes < _SHINGLE, counts)
    at = np.repeat(own.begins[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
    out = np.empty(len(at), np.uint64)
    out[short] = one[own.ids[at[short]]]
    at = at[~short]
    key, state = own.ids[at], one
    for k in range(1, _SHINGLE):  # distinct beginnings are numbered from 0, as terms are
        both, key = np.unique(key * n + own.ids[at + k], return_inverse=True)
        state = units.carry_on(units.carry_on(state[both // n], np.full(len(both), space)), both % n)
    if len(at):
        out[~short] = state[key]
    return out, counts


def simhash_of(own: Terms) -> np.ndarray:
    """A fingerprint for each text: the sign of each bit's vote over 3-term shingles; 0 without terms."""
    hashes, counts = _shingle_hashes(own)
    out = np.zeros(len(counts), np.uint64)
    ends = np.cumsum(counts)
    bits = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for i, (n, end) in enumerate(zip(counts.tolist(), ends.tolist(), strict=True)):
        if n:
            votes = np.unpackbits(bits[end - n : end], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * votes > n, bitorder="little").view("<u8")[0]
    return out


def simhash(text: Column) -> Column:
    """SimHash of the folded terms of each text, as a long with the same 64 bits."""
    return arrow_column("long", lambda c: pa.array(simhash_of(terms_of(c)).view(np.int64)), text)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
