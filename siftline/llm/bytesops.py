"""Vectorised word segmentation and hashing over the UTF-8 bytes of Arrow string columns.

All separators of the word definitions used here are ASCII, and every byte of a multi-byte UTF-8
character is 0x80 or more, so words of code points are exactly runs of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: [^\x20\x09-\x0D]
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[0x20] = NONSPACE[0x09:0x0E] = False

_BLOCK = 1 << 16
_P = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


_POW = _powers(_P, _BLOCK)
_INV = _powers(pow(_P, -1, 1 << 64), _BLOCK)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def text_chunks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows with about ``limit`` bytes; null is empty.

    A longer single text is one chunk of its own; texts are never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def segment(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the place of its first word (with one end more)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[buf]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _prefix_at(buf: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums (mod 2**64) before each of the ascending places, block by block."""
    out = np.empty(len(places), dtype=U64)
    carry, scale, step = 0, 1, pow(_P, _BLOCK, 1 << 64)
    cuts = np.searchsorted(places, np.arange(0, len(buf) + _BLOCK, _BLOCK))
    for i, lo in enumerate(range(0, max(len(buf), 1), _BLOCK)):
        part = buf[lo : lo + _BLOCK].astype(U64)
        part += U64(1)
        sums = np.zeros(len(part) + 1, dtype=U64)
        np.cumsum(part * _POW[: len(part)], out=sums[1:])
        a, b = cuts[i], cuts[i + 1]
        out[a:b] = U64(carry) + U64(scale) * sums[places[a:b] - lo]
        carry = (carry + scale * int(sums[-1])) & _M
        scale = (scale * step) & _M
    out[cuts[-1] :] = U64(carry)  # places at the very end of a buffer of whole blocks
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in each span; starts and ends ascend."""
    if not len(starts):
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        h = _prefix_at(buf, ends) - _prefix_at(buf, starts)
        blocks = starts // _BLOCK
        far = _powers(pow(pow(_P, _BLOCK, 1 << 64), -1, 1 << 64), int(blocks[-1]) + 1)
        h = h * _INV[starts % _BLOCK] * far[blocks]
        return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each place; len(words) - n + 1 of them, none if that is less than one."""
    m = len(words) - n + 1
    if m < 1:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        h = np.zeros(m, dtype=U64)
        for j in range(n):
            h = h * U64(0x9FB21C651E98DF25) + words[j : j + m]
        return mix(h + U64(n))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all spans, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, dtype=np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    heads = np.cumsum(n) - n
    out[0] = s[0]
    out[heads[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)
