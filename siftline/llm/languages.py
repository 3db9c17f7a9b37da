"""Language identification by error-correcting output codes over letter n-grams.

Every language has a code word of +1 and -1. For each bit a binary classifier tells the languages with +1
from those with -1: the log odds of hashed n-grams of 1 to 3 bytes within words, smoothed, each language with equal
weight. A text's margin of a bit is the sum of its n-grams' log odds over the square root of their number.
The language whose code word has the least loss is chosen, each bit's logistic loss weighted by how well its
classifier does on the rows it was learnt from; ``score`` is that language's share of exp(-loss), and texts
whose score is below ``SURE`` are flagged as ambiguous.

Up to five languages have all dichotomies as bits (4 languages: 7 bits, 4 bits apart); more have rows of a
Hadamard matrix, which differ in half of their distinct places (4 at least). Log odds are integers of 1/1024, so sums do not
depend on the order or the batches in which texts come.

Learnt from are about ``MOST_TEXTS`` texts a language, drawn by a hash of id and text (all of a language that has
fewer), and the ``MOST_LANGUAGES`` languages with most rows. Counts meet as (language, bucket, n), at most
languages x 32,768 rows, and the model is broadcast with 128 kB for each bit.

Rows: null texts and texts without a letter (Unicode category L) are ``und`` with score 0; every other text has a
learnt language, with equal losses the first by name; without any learnt language all are ``und``, with one it is that
for every text with a letter; null languages are not learnt; repeated rows are learnt from or left together;
very long texts are read whole, in pieces that end between words; an empty table gives no row.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, ragged, segment, text_chunks
from .quality import held_out
from .shared import text_batches

LENGTHS = (1, 2, 3)
BITS = 15
BUCKETS = 1 << BITS
MOST_TEXTS = 5_000
MOST_LANGUAGES = 127
SMOOTHING = 0.5
UNIT = 1024
SURE = 0.75
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_PIECE = 1 << 20
_SLICE = 1 << 16  # so many log odds add up within 32 bits
_DRAWS = 1 << 30


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, lower-cased bytes, offsets) of consecutive rows; a long text comes in pieces that end before a non-letter."""
    for lo, _, buf, offsets in text_chunks(column, _PIECE):
        low = LOWER[buf]
        # the capitals of two bytes that begin with C3 stand 32 below their small letters, but for the multiplication sign
        capital = np.flatnonzero((low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97) & (low[:-1] == 0xC3)) + 1
        low[capital] += 32
        if len(offsets) > 2 or len(low) <= 2 * _PIECE:
            yield lo, low, offsets
            continue
        gaps, at = np.flatnonzero(~_LETTER[low]), 0
        while at < len(low):
            after = np.searchsorted(gaps, at + _PIECE)
            end = int(gaps[after]) if after < len(gaps) else len(low)
            yield lo, low[at:end], np.array([0, end - at])
            at = end


def ngrams(low: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of the n-grams of each length, by ascending place; a word has one blank at either end."""
    starts, ends, begins = segment(low, offsets, _LETTER)
    sizes = ends - starts
    heads = np.concatenate([[0], np.cumsum(sizes + 1)])
    line = np.full(heads[-1] + max(LENGTHS), 32, np.uint32)
    line[ragged(heads[:-1] + 1, sizes)] = low[ragged(starts, sizes)]
    word = np.repeat(np.arange(len(sizes)), sizes + 1)
    left = heads[1:][word] - np.arange(heads[-1])  # bytes up to the blank behind the word
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(begins))[word]
    packed = np.zeros(heads[-1], np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        packed = packed | line[n - 1 : n - 1 + heads[-1]] << np.uint32(8 * (n - 1))
        if n in LENGTHS:
            own = np.flatnonzero(left >= n - 1)
            with np.errstate(over="ignore"):
                h = (packed[own] ^ np.uint32(n * 0x9E3779B)) * np.uint32(0x9E3779B1)
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
            yield text[own], (h >> np.uint32(32 - BITS)).astype(np.intp)


def code_words(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language; no column is constant and no two are equal or opposite."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    places = 1 << (languages - 1) if languages <= 5 else max(16, 1 << languages.bit_length())
    if languages <= 5:  # the first language is always +1, the others take every other choice of signs
        choice = np.arange(1, places)
        rows = [np.ones(places - 1, np.int64), *(1 - 2 * (choice >> i & 1) for i in range(languages - 1))]
        return np.stack(rows).astype(np.int8)
    i, j = np.arange(1, languages + 1)[:, None], np.arange(places)[None, :]
    words = (1 - 2 * (np.bitwise_count(i & j) & 1)).astype(np.int8)
    words = words[:, np.abs(words.sum(axis=0)) < languages]
    _, first = np.unique(words * words[:1], axis=1, return_index=True)
    return words[:, np.sort(first)]


@dataclass
class OutputCode:
    """Names of the languages, their code words, the log odds of each bit and bucket, and the weights of the bits."""

    names: list[str]
    words: np.ndarray
    odds: np.ndarray
    weights: np.ndarray

    def margins(self, column: pa.Array) -> np.ndarray:
        bits = self.words.shape[1]
        sums, count = np.zeros((len(column), bits), np.int64), np.zeros(len(column), np.int64)
        for first, low, offsets in _pieces(column):
            for text, bucket in ngrams(low, offsets):
                count[first : first + len(offsets) - 1] += np.bincount(text, minlength=len(offsets) - 1)
                for lo in range(0, len(text) if bits else 0, _SLICE):
                    own, places = text[lo : lo + _SLICE], bucket[lo : lo + _SLICE]
                    heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    for bit in range(bits):
                        sums[first + own[heads], bit] += np.add.reduceat(self.odds[bit].take(places, mode="clip"), heads)
        return sums / UNIT / np.sqrt(np.maximum(count, 1))[:, None]

    def shares(self, margins: np.ndarray) -> np.ndarray:
        """exp(-loss) of each language, the shares adding up to 1."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.words[None, :, :]) @ self.weights
        out = np.exp(loss.min(axis=1, initial=np.inf)[:, None] - loss)
        return out / out.sum(axis=1)[:, None]


def _gram_counts(texts: DataFrame, languages: int) -> np.ndarray:
    """Counts of each language and bucket; ``texts`` has text and language, a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((languages, BUCKETS), np.int64)
        for batch in batches:
            language = batch.column(1).to_numpy()
            for first, low, offsets in _pieces(batch.column(0)):
                for text, bucket in ngrams(low, offsets):
                    counts += np.bincount(language[first + text] * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)
        language, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(language, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[language, bucket])], names=["language", "bucket", "n"])

    found = texts.select("text", "language").mapInArrow(run, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((languages, BUCKETS))
    out[found["language"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _bit_weights(texts: DataFrame, model: OutputCode) -> np.ndarray:
    """1 - 2 x the share of errors of each bit on the texts it was learnt from, 0.05 at least."""
    bits = model.words.shape[1]
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrong, n = np.zeros(bits, np.int64), 0
        for batch in batches:
            words = shared.value.words[batch.column(1).to_numpy()]
            wrong += (shared.value.margins(batch.column(0)) * words <= 0).sum(axis=0)
            n += len(words)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits), pa.int32()), pa.array(wrong), pa.array(np.full(bits, n))], names=["bit", "wrong", "n"])

    out = np.full(bits, 0.05)
    for r in texts.select("text", "language").mapInArrow(run, "bit int, wrong long, n long").groupBy("bit").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n")).collect():
        out[r.bit] = max(0.05, 1 - 2 * r.wrong / r.n) if r.n else 0.05
    return out


def log_odds(counts: np.ndarray, words: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Of each bit and bucket, in integers of 1 / UNIT."""
    share = (counts + smoothing) / (counts.sum(axis=1) + smoothing * BUCKETS)[:, None]
    odds = [np.log(share[word > 0].mean(axis=0)) - np.log(share[word < 0].mean(axis=0)) for word in words.T]
    return np.rint(np.array(odds).reshape(-1, BUCKETS) * UNIT).astype(np.int32)


def fit(texts: DataFrame, most_texts: int = MOST_TEXTS, most_languages: int = MOST_LANGUAGES) -> OutputCode:
    """Learns from ``texts`` (doc_id, text, lang); what reaches the driver is bounded by the number of languages."""
    text_batches(texts.sparkSession)
    rows = texts.filter("text is not null and lang is not null")
    found = sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect())
    names = [name for name, _ in found]
    words = code_words(len(names))
    if not words.shape[1]:
        return OutputCode(names, words, np.zeros((0, BUCKETS), np.int32), np.zeros(0))
    drawn = [(name, i, -(-most_texts * _DRAWS // n)) for i, (name, n) in enumerate(found)]
    listed = texts.sparkSession.createDataFrame(drawn, "lang string, language int, bound long")
    sample = rows.select("text", "lang", (F.xxhash64("doc_id", "text").bitwiseAND(_DRAWS - 1)).alias("draw"))
    sample = sample.join(F.broadcast(listed), "lang").filter("draw < bound").select("text", "language")
    model = OutputCode(names, words, log_odds(_gram_counts(sample, len(names)), words), np.ones(words.shape[1]))
    model.weights = _bit_weights(sample, model)
    return model


def identify(text: Column | str, model: OutputCode, broadcast) -> Column:
    """A struct column: lang, score, ambiguous; ``broadcast`` is the context's function of that name."""
    shared = broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for column in batches:
            if own.names:
                share = own.shares(own.margins(column))
                best = share.argmax(axis=1)
                score = share[np.arange(len(best)), best]
                names = pa.array(own.names).take(pa.array(best))
            else:
                names, score = pa.array([UNKNOWN] * len(column)), np.zeros(len(column))
            yield pa.StructArray.from_arrays([names, pa.array(score, pa.float64()), pa.array(score < SURE)], fields=list(kind))

    text = F.col(text) if isinstance(text, str) else text
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    return F.when(text.rlike(r"\p{L}"), F.arrow_udf(run, "struct<lang:string,score:double,ambiguous:boolean>")(text)).otherwise(unknown)


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each document; learnt from the rows that are not held out."""
    model = fit(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    found = identify("text", model, docs.sparkSession.sparkContext.broadcast)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found"))
    return scored.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.ambiguous")
