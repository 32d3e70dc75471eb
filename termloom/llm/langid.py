"""Language identification by prediction by partial matching.

For each language a byte context tree of order 3 is counted: how often each byte
followed each context of up to three bytes. A byte's code length is that of the
longest known context; a byte unknown there costs an escape (method C: with N
occurrences and T different followers, a follower seen c times has probability
c / (N + T), an escape T / (N + T)) and is coded one order lower, at last as one
of 256. The statistics are frozen after training, so a byte's code length depends
on the last four bytes alone and whole columns are scored with table look-ups.
The language with the shortest exact code for the whole text wins.

ASCII letters are lower-cased, other ASCII bytes count as a space, and each text
is coded as if three spaces stood before it.

Defined cases: null text or text without any letter gives ``und`` and score 0; a
tie goes to the language that sorts first; rows that repeat are each told, and one
of them is learnt from; a very long text is coded whole, in memory some 30 times its
size; a null id is told and never learnt from; without training rows everything is
``und``; empty tables give none; columns beside id, text and lang are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import bytewords, common

ORDER = 3
UNDETERMINED = "und"

_b = bytewords.TO_LOWER
FOLD = np.where((_b >= 97) & (_b <= 122) | (_b >= 128), _b, 32).astype(np.uint8)


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes with ORDER spaces before each row; where each byte went; each byte's row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = np.arange(len(data)) + ORDER * (row + 1)
    out = np.full(len(data) + ORDER * (len(offsets) - 1), 32, np.uint8)
    out[place] = FOLD[data]
    return out, place, row


def _keys(padded: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes up to each place, as one number."""
    out = np.zeros(len(place), np.uint32)
    for back in range(n - 1, -1, -1):
        out = (out << np.uint32(8)) | padded[place - back]
    return out


@dataclass
class Level:
    """Contexts of one length: code lengths in bits by language, and of an escape."""

    keys: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escapes: np.ndarray


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted table, whether it is there)."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    levels: list[Level] = field(default_factory=list)

    def bits(self, padded: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Code length of each byte in each language."""
        return self._bits_of(_keys(padded, place, ORDER + 1), ORDER)

    def _bits_of(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order < 0:
            return np.full((len(keys), len(self.languages)), 8.0, np.float32)
        level = self.levels[order]
        at, there = self._located(keys, order)
        out = level.bits[at]
        if not there.all():
            missed = np.flatnonzero(~there)
            rest = keys[missed]
            shorter = rest & np.uint32((1 << (8 * order)) - 1) if order else rest
            known, inside = _find(level.contexts, rest >> np.uint32(8))
            escape = np.where(inside[:, None], level.escapes[known], 0).astype(np.float32)
            out[missed] = escape + self._bits_of(shorter, order - 1)
        return out

    def _located(self, keys: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """As _find in the level's keys; the top level goes by a table of byte pairs where that is small."""
        if order != ORDER:
            return _find(self.levels[order].keys, keys)
        if not hasattr(self, "_pairs"):
            top = self.levels[ORDER].keys
            pairs = np.unique(np.concatenate([top >> np.uint32(16), top & np.uint32(0xFFFF)])) if len(top) else np.zeros(0, np.uint32)
            number = np.zeros(65536, np.int64)
            number[pairs] = np.arange(1, len(pairs) + 1)
            grid = None
            if len(pairs) <= 3000:
                grid = np.full((len(pairs) + 1) ** 2, -1, np.int32)
                grid[number[top >> np.uint32(16)] * (len(pairs) + 1) + number[top & np.uint32(0xFFFF)]] = np.arange(len(top))
            self._pairs = number, len(pairs) + 1, grid
        number, width, grid = self._pairs
        if grid is None:
            return _find(self.levels[ORDER].keys, keys)
        at = grid[number[keys >> np.uint32(16)] * width + number[keys & np.uint32(0xFFFF)]]
        there = at >= 0
        return np.where(there, at, 0), there

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "levels": self.levels}

    def predict(self, column) -> tuple[list[str], np.ndarray]:
        """(language, share of the winner in the posterior) of each text of an Arrow string column."""
        n = len(column)
        data, offsets = bytewords.column_bytes(column)
        lettered = _has_letter(data, offsets, column)
        if not self.languages or not n:
            return [UNDETERMINED] * n, np.zeros(n)
        padded, place, row = _padded(data, offsets)
        total = np.zeros((n, len(self.languages)))
        step = max(1 << 14, (1 << 19) // len(self.languages))
        for at in range(0, len(place), step):
            bits = self.bits(padded, place[at : at + step])
            for k in range(len(self.languages)):
                total[:, k] += bytewords.row_sums(bits[:, k], row[at : at + step], n)
        best = total.argmin(axis=1)
        share = 1 / np.exp2(np.maximum(total.min(axis=1, keepdims=True) - total, -1000)).sum(axis=1)
        return [self.languages[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)], np.where(lettered, share, 0.0)


def _has_letter(data: np.ndarray, offsets: np.ndarray, column) -> np.ndarray:
    """Whether a text has a letter; only texts without ASCII letters are looked at one by one."""
    lower = bytewords.TO_LOWER[data]
    seen = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out):
        text = column[int(i)].as_py()
        out[i] = any(c.isalpha() for c in text or "")
    return out


def _runs_sum(counts: np.ndarray, group: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.add.reduceat(counts, starts, axis=0)


def train(texts: dict[str, list[str]]) -> Model:
    """Context trees from texts by language."""
    import pyarrow as pa

    languages = sorted(k for k, v in texts.items() if v)
    if not languages:
        return Model()
    prepared = [_padded(*bytewords.column_bytes(pa.array(texts[k], pa.string()))) for k in languages]
    levels: list[Level] = []
    for order in range(ORDER + 1):
        each = [np.unique(_keys(padded, place, order + 1), return_counts=True) for padded, place, _ in prepared]
        keys = np.unique(np.concatenate([k for k, _ in each]))
        counts = np.zeros((len(keys), len(languages)))
        for i, (k, c) in enumerate(each):
            counts[np.searchsorted(keys, k), i] = c
        if not len(keys):
            levels.append(Level(keys, counts.astype(np.float32), keys, counts.astype(np.float32)))
            continue
        context = keys >> np.uint32(8)
        contexts, inverse = np.unique(context, return_inverse=True)
        total, kinds = _runs_sum(counts, context), _runs_sum((counts > 0).astype(float), context)
        escapes = np.where(total > 0, -np.log2(np.maximum(kinds, 1) / np.maximum(total + kinds, 1)), 0.0)
        shorter = keys & np.uint32((1 << (8 * order)) - 1) if order else keys
        below = Model(languages, levels)._bits_of(shorter, order - 1)
        seen = -np.log2(np.maximum(counts, 1) / np.maximum(total + kinds, 1)[inverse])
        bits = np.where(counts > 0, seen, escapes[inverse] + below)
        levels.append(Level(keys, bits.astype(np.float32), contexts, escapes.astype(np.float32)))
    return Model(languages, levels)


def fit(documents: DataFrame, *, per_language: int = 300, modulus: int = 4, held_remainder: int = 2) -> Model:
    """Train on the whole texts of at most ``per_language`` ids of each language, none of them held out."""
    known = documents.where(F.col("lang").isNotNull()).where(common.id_remainder("doc_id", modulus) != held_remainder).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where("doc_id is not null")
    sample, counts = common.sampled_by_class(known, "lang", per_language)
    texts: dict[str, list[str]] = {k: [] for k in counts}
    for r in common.training_texts(known.join(F.broadcast(sample), ["doc_id", "lang"]), "lang"):
        if r["text"]:
            texts[r["lang"]].append(r["text"])
    return train(texts)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text."""
    import pyarrow as pa

    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator) -> Iterator:
        for batch in common.byte_batches(batches, 1 << 19):
            named, share = shared.value.predict(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(named, pa.string()), pa.array(share, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return common.in_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scored, "doc_id long, lang_pred string, score double")


def keep(documents: DataFrame, model: Model, *, least_share: float) -> DataFrame:
    """The rows of ``documents``, with all their columns, that have a language with at least that share of the posterior."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def told(texts) -> np.ndarray:  # noqa: ANN001
        named, share = shared.value.predict(texts)
        return (np.array(named, object) != UNDETERMINED) & (share >= least_share)

    return common.kept_rows(documents, told, 1 << 19)


def identify(documents: DataFrame, *, modulus: int = 4, held_remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document."""
    model = fit(documents, modulus=modulus, held_remainder=held_remainder)
    return score(documents, model).select("doc_id", (common.id_remainder("doc_id", modulus) == held_remainder).alias("held_out"), "lang_pred", "score")
