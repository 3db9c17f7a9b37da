"""Byte-level BPE ids of whole texts with the ``tokenizers`` library, many texts at a time.

A byte-level tokeniser first splits a text into runs of letters, digits or other characters, each
with the one space before it, and merges nothing across these runs. Texts are therefore cut where such
a run certainly ends, the parts of a batch are dictionary-encoded by Arrow, and only parts that were
not met before go to the library; ids are then gathered by index. Where the end of a run is in
doubt there is no cut, and the part goes through the library's own splitting, so the ids are those of
the whole text. Files of any other kind of tokeniser, and texts that hold a special token, are
encoded whole by the library.

The table of parts has at most about ``most_parts`` entries; beyond, parts met in one batch only go first.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa

from .bytesops import ragged
from .shared import give_back

MOST_PARTS = 250_000
BLOCK = 2 << 20  # bytes of text that are cut at once
_LOADED: dict[str, "Encoder"] = {}

# Classes of bytes. Letters are ASCII and the letters of Latin-1 (two bytes, the first 0xC3); OTHER is all that is in doubt.
_OTHER, _LETTER, _DIGIT, _MARK, _SPACE, _LINE, _QUOTE = range(7)
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[32], _CLASS[10], _CLASS[39] = _SPACE, _LINE, _QUOTE

_NEVER, _ALWAYS, _AFTER_OTHER, _AFTER_LINE = range(4)
_RULES = np.zeros((8, 8), np.uint8)
for _a in (_LETTER, _DIGIT, _MARK, _QUOTE):
    _RULES[_a, [_SPACE, _LINE]] = _ALWAYS
for _a in (_LETTER, _DIGIT, _MARK):
    _RULES[_a, [b for b in (_LETTER, _DIGIT, _MARK) if b != _a]] = _ALWAYS
    _RULES[_LINE, _a] = _AFTER_LINE
_RULES[_OTHER, [_SPACE, _LINE]] = _AFTER_OTHER
_RULES = _RULES.ravel()

#: Last bytes of white space beyond ASCII, and those before them; a few other characters end alike and only lose a cut.
_WIDE_END, _WIDE_BEFORE = np.zeros(256, bool), np.zeros(256, bool)
_WIDE_END[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_WIDE_BEFORE[[0xC2, 0x80, 0x81, 0x9A]] = True

#: A part that is one run of one class, so that nothing is left to split.
_ONE_RUN = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n")


def cuts(buf: np.ndarray) -> np.ndarray:
    """Places inside the bytes of UTF-8 text, ascending, before which a run certainly begins."""
    kind = _CLASS[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    letter = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
    kind[letter] = kind[letter + 1] = _LETTER
    rule = _RULES[(kind[:-1] << 3) | kind[1:]]
    at = np.flatnonzero(rule) + 1
    rule = rule[at - 1]
    doubt = np.flatnonzero(rule != _ALWAYS)
    if not len(doubt):
        return at
    place, keep = at[doubt], np.zeros(len(doubt), bool)
    before = np.maximum(place - 2, 0)
    line = rule[doubt] == _AFTER_LINE
    keep[line] = np.isin(kind[before[line]], (_LETTER, _DIGIT, _MARK, _QUOTE))  # a line feed alone
    wide = ~line & (buf[place - 1] >= 0x80) & (place >= 2)
    keep[wide] = ~(_WIDE_END[buf[place[wide] - 1]] & _WIDE_BEFORE[buf[before[wide]]])
    stay = np.ones(len(at), bool)
    stay[doubt] = keep
    return at[stay]


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next from 256 on."""
    out, spare = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


_BYTE_CHARACTERS = _byte_characters()


class Encoder:
    def __init__(self, path: str, most_parts: int):
        self.most_parts, self.block = most_parts, BLOCK
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(Path(path).read_text(encoding="utf-8"))
        split, model = made.get("pre_tokenizer") or {}, made["model"]
        odd = [model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")]
        self.splits = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not made.get("normalizer") and not any(odd)
        vocabulary = self.tokenizer.get_vocab()
        self.splits = self.splits and all(c in vocabulary for c in _BYTE_CHARACTERS.values())
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)  # bytes of each id
        self.sizes[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.special = [t["content"].encode() for t in made.get("added_tokens") or []]
        self.runs = Tokenizer(self.tokenizer.model)  # no splitting: for parts that are one run
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths, self.met = (np.zeros(1 << 14, t) for t in (np.int64, np.int64, np.int32))

    def release(self) -> None:
        """Gives the memory of the table back, for what runs in this worker next."""
        self._clear()
        give_back()

    def _keep(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        k, n = len(self.place), len(parts)
        while k + n > len(self.starts):
            self.starts, self.lengths, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.met))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[k : k + n], self.lengths[k : k + n], self.met[k : k + n] = self.used + np.cumsum(lengths) - lengths, lengths, 0
        self.place.update(zip(parts, range(k, k + n), strict=True))
        self.used += len(ids)

    def _forget(self) -> None:
        """Keeps at most half of the table, the parts that were met in most batches."""
        n = len(self.place)
        met = self.met[:n]
        least = max(2, int(np.sort(met)[-(self.most_parts // 2)])) if n > self.most_parts // 2 else 2
        keep = np.flatnonzero(met >= least)[: self.most_parts // 2]
        parts = list(self.place)
        starts, lengths, seen = self.starts[keep], self.lengths[keep], met[keep] // 2
        ids = self.pool[ragged(starts, lengths)]
        kept = [parts[i] for i in keep.tolist()]
        self._clear()
        self._keep(kept, ids, lengths)
        self.met[: len(kept)] = seen

    def _learn(self, parts: list[str]) -> None:
        plain = list(map(_ONE_RUN.fullmatch, parts))
        simple, rest = [p for p, m in zip(parts, plain, strict=True) if m], [p for p, m in zip(parts, plain, strict=True) if not m]
        if simple:
            drawn = "\x00".join(simple).encode().decode("latin-1").translate(_BYTE_CHARACTERS).split(_BYTE_CHARACTERS[0])
            groups = [drawn[i : i + 512] for i in range(0, len(drawn), 512)]
            done = 0
            for k in range(0, len(groups), 32):
                for group, e in zip(groups[k : k + 32], self.runs.encode_batch_fast(groups[k : k + 32], is_pretokenized=True, add_special_tokens=False), strict=True):
                    ids = np.array(e.ids, dtype=np.int32)
                    ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w) for w in group])) + 1
                    self._keep(simple[done : done + len(group)], ids, np.diff(ends, prepend=0))
                    done += len(group)
        if rest:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            lengths = np.array([len(x) for x in found], np.int64)
            self._keep(rest, np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), lengths)

    def _ids_of_block(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts between consecutive bounds, and how many each part has."""
        parts = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(buf)).dictionary_encode()
        distinct = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.place) + len(distinct) > self.most_parts and self.place:
            self._forget()
        at = np.fromiter(map(self.place.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(missing := np.flatnonzero(at < 0)):
            absent = [distinct[i] for i in missing.tolist()]
            self._learn(absent)
            at[missing] = np.fromiter(map(self.place.__getitem__, absent), np.int64, len(absent))
        self.met[at] += 1
        places = at[parts.indices.to_numpy()]
        lengths = self.lengths[places]
        return self.pool[ragged(self.starts[places], lengths)], lengths

    def _ids_in_parts(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of each text's ids. Blocks end at cuts, so a long text needs no more room than many short ones."""
        out, sizes, lo, reach = [], np.zeros(len(offsets) - 1, np.int64), 0, self.block
        while lo < len(buf):
            hi = min(len(buf), lo + reach)
            back = min(lo, 3)
            inner = cuts(buf[lo - back : hi]) + lo - back
            edges = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi)]
            begins = np.zeros(hi - lo, bool)
            begins[inner[inner > lo] - lo] = begins[edges - lo] = True
            bounds = np.flatnonzero(begins) + lo
            if hi < len(buf):
                if not len(bounds):
                    reach *= 2  # no place to cut yet
                    continue
            else:
                bounds = np.append(bounds, hi)
            bounds, end, reach = np.concatenate([[lo], bounds]), int(bounds[-1]), self.block
            ids, lengths = self._ids_of_block(buf[lo:end], bounds - lo)
            text = np.searchsorted(offsets, bounds[:-1], "right") - 1
            first = np.flatnonzero(np.diff(text, prepend=-1))
            np.add.at(sizes, text[first], np.add.reduceat(lengths, first))
            out.append(ids)
            lo = end
        return np.concatenate(out) if out else np.zeros(0, np.int32), sizes

    def _ids_whole(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [buf[a:b].tobytes().decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        found = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(found) if found else np.zeros(0, np.int32), np.array([len(x) for x in found], np.int64)

    def encode(self, buf: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end``, and the n + 1 places where the texts begin."""
        data = buf.tobytes() if self.special else b""
        plain = self.splits and not any(s in data for s in self.special)
        ids, sizes = (self._ids_in_parts if plain else self._ids_whole)(buf, offsets)
        ends = np.cumsum(sizes)
        out = np.empty(len(ids) + len(sizes), np.int32)
        closing = ends + np.arange(len(sizes))
        own = np.ones(len(out), bool)
        own[closing] = False
        out[own], out[closing] = ids, end
        return out, np.concatenate([[0], closing + 1])


def encoder(path: str, most_parts: int = MOST_PARTS, block: int | None = None) -> Encoder:
    """One encoder for each worker process and vocabulary file; some 300 bytes for each part that it remembers."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path, most_parts)
    _LOADED[path].most_parts, _LOADED[path].block = most_parts, block or BLOCK
    return _LOADED[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
