"""A regularised quadratic discriminant over transformed document statistics.

Statistics of the bytes, words and lines of a text are transformed to be nearly normal. Moments of
each class are summed over the labelled rows, at most ``MOST_LABELS`` ids; class covariances are shrunk towards the pooled one
and that towards a multiple of the identity. A score is the posterior of label 1: the difference of
the two log densities, each a Mahalanobis distance through the inverse of a Cholesky factor that is
computed once.

Rows: null and empty texts have statistics like any other and get a score in [0, 1]; a document
whose labels disagree counts with the rounded mean, null labels and labels without a document do not
count; without labels of both classes every score is the share of label 1, or 0.5 without any.
Repeated rows get equal scores. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesops import LOWER, NONSPACE, U64, mix, ngram_hashes, segment, span_hashes, text_chunks
from .shared import give_back, text_batches

THRESHOLD = 0.7
TO_POOLED = 0.1
TO_IDENTITY = 0.01
MOST_LABELS = 100_000

_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_UPPER, _LETTER, _DIGIT, _STOP = _class((65, 90)), _class((65, 90), (97, 122), (128, 255)), _class((48, 57)), _class((44, 44), (46, 46))
_SYMBOL = _class((33, 43), (45, 45), (47, 47), (58, 64), (91, 96), (123, 126))
_HIGH = _class((128, 255))


def _distinct(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Distinct hashes of each text."""
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    with np.errstate(over="ignore"):
        own = mix(hashes + mix(text.astype(U64) + U64(1)))
    _, first = np.unique(own, return_index=True)
    return np.bincount(text[first], minlength=len(begins) - 1)


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text."""
    n = np.diff(offsets)

    def count(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(table[buf])])[offsets])

    starts, ends, words = segment(buf, offsets, NONSPACE)
    low = LOWER[buf]
    hashes = span_hashes(low, starts, ends)
    n_words = np.diff(words)
    line_starts, line_ends, lines = segment(buf, offsets, _LINE)
    n_lines = np.diff(lines)
    marked = np.concatenate([[0], np.cumsum(_SYMBOL[buf[ends - 1]])])[words] if len(ends) else np.zeros(len(words))
    # a few imagined characters, words and lines of usual text keep the shares of short texts from extremes
    letters, size, own_words, own_lines = count(_LETTER) + 40, n + 50, n_words + 8, n_lines + 2
    pairs = ngram_hashes(np.append(hashes, U64(0)), 2)  # a pair across a border counts for the earlier text
    return np.stack(
        [
            np.log1p(n_words),
            np.log(size / own_words),
            np.sqrt((count(_UPPER) + 1) / letters),
            np.sqrt(count(_DIGIT) / size),
            np.sqrt(count(_SYMBOL) / size),
            np.sqrt((count(_STOP) + 1) / size),
            np.sqrt(np.diff(marked) / own_words),
            np.log(_distinct(hashes, words) + 8) / np.log(own_words),
            np.log(_distinct(pairs, words) + 8) / np.log(own_words),
            (_distinct(span_hashes(low, line_starts, line_ends), lines) + 2) / own_lines,
            np.log1p(n / np.maximum(n_lines, 1)),
            np.sqrt(count(_HIGH) / size),
        ],
        axis=1,
    ).astype(np.float64)


SIZE = 12


def document_statistics(text: Column | str) -> Column:
    """The statistics of each text as an array of doubles."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows = [statistics(buf, offsets) for _, _, buf, offsets in text_chunks(column)]
            flat = np.concatenate(rows) if rows else np.zeros((0, SIZE))
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, SIZE), pa.int32()), pa.array(flat.ravel()))

    return F.arrow_udf(run, "array<double>")(text)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log weights of the classes 0 and 1."""

    share: float
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    weights: np.ndarray | None = None

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.means is None:
            return np.full(len(rows), self.share)
        logs = [w - 0.5 * (((rows - m) @ f.T) ** 2).sum(axis=1) for m, f, w in zip(self.means, self.factors, self.weights, strict=True)]
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -35, 35)))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = np.zeros((2, 1 + SIZE + SIZE * SIZE))
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE)
        y = batch.column(1).to_numpy(zero_copy_only=False)
        for k in (0, 1):
            own = x[y == k]
            sums[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    k, place = np.indices(sums.shape)
    yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(place.ravel(), pa.int32()), pa.array(sums.ravel())], names=["k", "place", "value"])


def fit(docs: DataFrame, labels: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY, most_labels: int = MOST_LABELS) -> Discriminant:
    """Learns from the rows of ``docs`` that ``labels`` (doc_id, label) names; only sums of fixed size reach the driver.

    Of more than ``most_labels`` labelled ids, those of least hash are learnt from, so what is broadcast is
    bounded and statistics are computed of no other text.
    """
    text_batches(docs.sparkSession)
    labels = labels.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("label")).cast("int").alias("label"))
    few = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select(document_statistics("text").alias("x"), "label")
    sums = rows.mapInArrow(_moments, "k int, place int, value double").groupBy("k", "place").agg(F.sum("value").alias("value")).collect()
    table = np.zeros((2, 1 + SIZE + SIZE * SIZE))
    for r in sums:
        table[r.k, r.place] = r.value
    n = table[:, 0]
    if n.min() < 2:
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5)
    means = table[:, 1 : 1 + SIZE] / n[:, None]
    spread = table[:, 1 + SIZE :].reshape(2, SIZE, SIZE) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (spread * n[:, None, None]).sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    factors, weights = [], []
    for own, count in zip(spread, n, strict=True):
        c = ((1 - to_pooled) * own + to_pooled * pooled) / np.outer(scale, scale)
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / SIZE, 1e-6) * np.eye(SIZE)
        lower = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(lower) / scale[None, :])
        weights.append(np.log(count / n.sum()) - np.log(np.diag(lower)).sum())
    return Discriminant(float(n[1] / n.sum()), means, np.array(factors), np.array(weights))


def score(text: Column | str, model: Discriminant) -> Column:
    """The posterior of label 1 for each text; the model travels with the function (some kB)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            own = [model.score(statistics(buf, offsets)) for _, _, buf, offsets in text_chunks(column)]
            yield pa.array(np.concatenate(own) if own else np.zeros(0), pa.float64())
        give_back()

    return F.arrow_udf(run, "double")(text)


def _remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def held_out(doc_id: Column) -> Column:
    return _remainder(doc_id, 4) == 2


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; learnt from the rows that are not held out."""
    training = labels.select("doc_id", F.col("quality").alias("label")).filter(~held_out(F.col("doc_id")))
    model = fit(docs, training)
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of at least ``THRESHOLD``, with all their columns."""
    training = labels.select("doc_id", F.col("quality").alias("label")).filter(~held_out(F.col("doc_id")))
    return docs.filter(score("text", fit(docs, training)) >= THRESHOLD)
