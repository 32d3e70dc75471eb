"""Text quality by logistic regression over hashed word n-grams.

Tokens are runs of word characters and runs of punctuation. The features are
hashed n-grams: single tokens and pairs of tokens (words lower-cased), and pairs
and triples of token shapes. A shape keeps punctuation as it is and tells a word
only by its case, its digits and whether it repeats the word before, so that
layout habits carry over to words never seen. A text's feature is the share of
the n-gram among the text's n-grams of its kind; a score is the sparse dot
product, read as a probability.

Weights are trained by follow-the-regularised-leader (FTRL-proximal) updates,
one labelled text at a time in a fixed shuffled order.

Defined cases: a null or empty text has no feature and gets the score of the
intercept; equal texts get equal scores, and rows that repeat are each scored; a
very long text is scored whole, in memory a few times its size; a null id is scored
and never learnt from; of an id with several texts one is learnt, of one with
several labels the larger; without training rows every score is 0.5; empty tables
give none; columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import bytewords, common

BITS = 18
SCALE = 8.0

_b = np.arange(256)
_WORD = ((_b >= 48) & (_b <= 57)) | ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
#: Kind of byte: 0 blank or control, 1 word, 2 punctuation.
_KIND = np.where(_WORD, 1, np.where((_b > 32) & (_b < 127), 2, 0)).astype(np.uint8)
_IS_UPPER = (_b >= 65) & (_b <= 90)
_IS_DIGIT = (_b >= 48) & (_b <= 57)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed feature, its row, its value) of every n-gram."""
    kind = _KIND[data]
    starts, ends = bytewords.runs(kind, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row = np.searchsorted(offsets, starts, side="right") - 1
    token = bytewords.span_hashes(bytewords.TO_LOWER[data], starts, ends)
    upper = np.concatenate([[0], np.cumsum(_IS_UPPER[data])])
    digit = np.concatenate([[0], np.cumsum(_IS_DIGIT[data])])
    n_upper, n_digit = upper[ends] - upper[starts], digit[ends] - digit[starts]
    first = _IS_UPPER[data[starts]]
    case = np.where(n_upper == 0, 0, np.where((n_upper == 1) & first, 1, np.where(n_upper >= ends - starts - 1, 2, 3))) + 4 * (n_digit > 0)
    is_word = kind[starts] == 1
    words = np.flatnonzero(is_word)
    again = np.zeros(len(starts), bool)
    again[words[1:]] = (token[words[1:]] == token[words[:-1]]) & (row[words[1:]] == row[words[:-1]])
    shape = np.where(is_word, (case + 16 * again).astype(np.uint64), token)
    out = []
    for salt, (hashes, rows) in enumerate(((token, row), bytewords.ngrams(token, row, 2), bytewords.ngrams(shape, row, 2), bytewords.ngrams(shape, row, 3))):
        n = np.bincount(rows, minlength=len(offsets) - 1)
        slot = (bytewords.mixed(hashes ^ np.uint64(salt << 60)) >> np.uint64(64 - BITS)).astype(np.int64)
        out.append((slot, rows, SCALE / n[rows]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << BITS, np.float32))
    intercept: float = 0.0

    def scores(self, column) -> np.ndarray:
        data, offsets = bytewords.column_bytes(column)
        slot, row, value = features(data, offsets)
        z = self.intercept + bytewords.row_sums(self.weights[slot] * value, row, len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def examples(texts: list[str], together: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """(different slots, their values) of each text; a few texts at a time, to keep memory small."""
    import pyarrow as pa

    out = []
    for at in range(0, len(texts), together):
        data, offsets = bytewords.column_bytes(pa.array(texts[at : at + together], pa.string()))
        slot, row, value = features(data, offsets)
        order = np.lexsort((slot, row))
        slot, row, value = slot[order], row[order], value[order]
        heads = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (row[1:] != row[:-1])])) if len(slot) else np.zeros(0, int)
        slots, values = slot[heads].astype(np.int32), (np.add.reduceat(value, heads) if len(heads) else np.zeros(0)).astype(np.float32)
        bounds = np.searchsorted(row[heads], np.arange(len(offsets)))
        out += [(slots[a:b].copy(), values[a:b].copy()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def train(texts: list[str], marks: list[int], weight: dict[int, float] | None = None, *, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """FTRL-proximal over the texts. ``weight``: how much a text of each mark counts."""
    if not texts:
        return Model()
    rows = examples(texts)
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def active(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    shuffled = np.random.default_rng(7)
    for _ in range(epochs):
        for i in shuffled.permutation(len(texts)):
            at, x = np.append(rows[i][0], size - 1), np.append(rows[i][1], 1.0)
            w = active(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - marks[i]) * x * (weight or {}).get(marks[i], 1.0)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = active(np.arange(size))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def fit(documents: DataFrame, labels: DataFrame, *, per_class: int = 3000, modulus: int = 5, held_remainder: int = 0) -> Model:
    """Train on at most ``per_class`` labelled rows of each kind, none of them held out."""
    kinds = labels.where(F.col("quality").isin(0, 1)).where(common.id_remainder("doc_id", modulus) != held_remainder).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample, counts = common.sampled_by_class(kinds, "quality", per_class)
    rows = common.training_texts(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id"), "quality")
    kept = {k: sum(r["quality"] == k for r in rows) for k in (0, 1)}
    weight = {k: counts.get(k, 0) / max(1, kept[k]) for k in (0, 1)}
    top = max(weight.values(), default=1.0) or 1.0
    return train([r["text"] for r in rows], [r["quality"] for r in rows], {k: v / top for k, v in weight.items()})


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row's whole text."""
    import pyarrow as pa

    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator) -> Iterator:
        for batch in common.byte_batches(batches, 1 << 19):
            yield pa.record_batch([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")), pa.float64())], names=["doc_id", "score"])

    return common.in_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scored, "doc_id long, score double")


def classify(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.3, modulus: int = 5, held_remainder: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    model = fit(documents, labels, modulus=modulus, held_remainder=held_remainder)
    return score(documents, model).select("doc_id", (common.id_remainder("doc_id", modulus) == held_remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
