"""Toxicity by compression distance.

Two separate zstandard dictionaries of equal size are trained, one on ordinary and one
on toxic texts. A window of a text is compressed with either; the bytes that the toxic
one saves say how toxic the window is. Windows cover the whole text.

Most of a toxic text is ordinary, so beside the lengths a text is looked at for
byte 8-grams that occur much more often in toxic training texts than in ordinary ones.
Languages differ in their words, and a word that is toxic in one
may be harmless in another or too rare to stand out among all. So training
texts are grouped by their byte pairs (spherical k-means, which separates
languages; no other column is read), occurrences are counted within a group, and a
text is looked at with the grams of the group it is nearest to.

Mean, largest and root-mean-square gain, and the evidence (log ratios of
occurrence, one for each marked span) in the stretch that has most of it, are
turned into a score by a logistic curve, with terms for each group. It is calibrated on labelled texts by cross-fitting: each third
is measured by a model of the other two.

Defined cases: a null or empty text has one blank window and gets the score of
no gain; equal texts get equal scores, and rows that repeat are each scored; a very
long text is scored whole, in memory a few times its size; a null id is scored and
never learnt from; of an id with several texts one is learnt, of one with several
labels the larger; without toxic or without ordinary training rows every score is 0;
empty tables give none; columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import common

GRAM = 8
WINDOW = 128
#: Byte-pair profiles have so many places; groups at first; training rows of each kind that a group has at least.
PLACES, GROUPS, LEAST_ROWS = 4096, 12, 8
#: Toxic texts of a group in which a marked gram stands at least (a third of them where they are few).
LEAST_TEXTS = 5
#: Scale of each group's constant and evidence, so that the ridge holds them near those of all groups.
GROUP_TERMS = 0.3, 0.1
#: Bytes of a stretch in which evidence adds up, and its bound.
STRETCH, MOST_EVIDENCE = 512, 30.0
#: More occurrences in ordinary texts than were seen, so that a gram of few texts does not stand out by chance.
UNSEEN = 2
#: Bytes of a text that are looked at in one piece.
PIECE = 1 << 20
#: A run that always compresses keeps zstandard from storing a small window raw.
LEAD = b"\n" * 48


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes):  # noqa: ANN202
    import zstandard as zs

    size = {"hash_log": 14, "chain_log": 14, "search_log": 3, "min_match": 3, "target_length": 32, "window_log": 15}
    how = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False, **size)
    words = zs.ZstdCompressionDict(dictionary)
    words.precompute_compress(compression_params=how)
    return zs.ZstdCompressor(compression_params=how, dict_data=words)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    window: int = WINDOW
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    centres: np.ndarray = field(default_factory=lambda: np.zeros((1, PLACES), np.float32))
    #: (sorted grams, log ratio of each) of each group.
    marks: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def gains(self, texts: list[bytes]) -> np.ndarray:
        """(mean, largest, root mean square) gain in bytes over the windows of each text."""
        plain, toxic = _compressor(self.ordinary), _compressor(self.toxic)
        out = np.zeros((len(texts), 3))
        for i, text in enumerate(texts):
            gain = np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text, self.window)], float)
            out[i] = gain.mean(), max(gain.max(), 0), np.sqrt((np.maximum(gain - 1, 0) ** 2).mean())
        return out

    def evidence(self, texts: list[bytes], group: np.ndarray) -> np.ndarray:
        """The most evidence that a stretch of each text holds."""
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            starts, _, value = marked_spans(text, *self.marks[group[i]])
            if len(starts):
                sums = np.concatenate([[0], np.cumsum(value)])
                out[i] = (sums[np.searchsorted(starts, starts + STRETCH)] - sums[:-1]).max()
        return np.minimum(out, MOST_EVIDENCE)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(texts))
        z = self.inputs([normalised(t) for t in texts]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def inputs(self, texts: list[bytes]) -> np.ndarray:
        """What the curve is over: gains, evidence, and both evidence and a constant for each group."""
        gains, group = self.gains(texts), nearest(profiles(texts), self.centres)
        evidence, member = self.evidence(texts, group), np.eye(len(self.centres))[group]
        return np.column_stack([np.ones(len(gains)), gains[:, 0], np.log1p(gains[:, 1]), gains[:, 2], evidence, GROUP_TERMS[0] * member, GROUP_TERMS[1] * member * evidence[:, None]])


def windows(text: bytes, size: int) -> Iterator[bytes]:
    """The whole text in windows of at most ``size`` bytes, cut at spaces where there are some."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            end = text.rfind(b" ", at + 1, end) + 1 or end
        # the next window begins with the space, as words in the dictionaries do
        yield LEAD + text[at:end]
        at = end - (end < len(text) and text[end - 1 : end] == b" " and end - 1 > at)


def normalised(text: str | None) -> bytes:
    return b" " + b" ".join((text or "").lower().encode("utf-8", "replace").split()) + b" "


def _grams(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(a) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        out = (out << np.uint64(8)) | a[i : i + len(out)]
    return out


def profiles(texts: list[bytes]) -> np.ndarray:
    """Root frequencies of the hashed byte pairs of each text, as unit vectors."""
    out = np.zeros((len(texts), PLACES), np.float32)
    for i, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            a = np.frombuffer(text[at : at + PIECE + 1], np.uint8).astype(np.uint32)
            out[i] += np.bincount(((a[:-1] << 8 | a[1:]) * np.uint32(40503) >> np.uint32(4)) % PLACES, minlength=PLACES)
    out = np.sqrt(out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def nearest(profile: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (profile @ centres.T).argmax(axis=1)


def grouped(profile: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Centres of the groups. Those with few rows of a kind are given up, and their rows go to the next nearest."""
    centres = [profile[int((profile @ profile.mean(0)).argmin())]]
    for _ in range(GROUPS - 1):
        centres.append(profile[int((profile @ np.array(centres).T).max(axis=1).argmin())])
    centres = np.array(centres)
    for _ in range(10):
        group = nearest(profile, centres)
        for j in np.unique(group):
            mean = profile[group == j].mean(0)
            centres[j] = mean / max(np.linalg.norm(mean), 1e-9)
    while len(centres) > 1:
        group = nearest(profile, centres)
        rows = np.minimum(np.bincount(group[toxic], minlength=len(centres)), np.bincount(group[~toxic], minlength=len(centres)))
        if rows.min() >= LEAST_ROWS:
            break
        centres = np.delete(centres, rows.argmin(), axis=0)
    return centres


def _frequencies(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(grams, in how many different texts each stands, how often it occurs there, all occurrences)."""
    each = [np.unique(_grams(t), return_counts=True) for t in dict.fromkeys(texts)]
    if not each:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0), 0
    grams, place, n = np.unique(np.concatenate([g for g, _ in each]), return_inverse=True, return_counts=True)
    times = np.bincount(place, weights=np.concatenate([c for _, c in each]), minlength=len(grams))
    return grams, n, times, int(times.sum())


def toxic_grams(toxic: list[bytes], ordinary: list[bytes], share: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(grams, log ratios): those that stand in ``share`` of the toxic texts and occur ``ratio`` times more often than in ordinary ones."""
    grams, n, times, total = _frequencies(toxic)
    # near copies of one text must not make its words toxic
    often = n >= max(2, min(LEAST_TEXTS, len(toxic) / 3), share * len(toxic))
    grams, times = grams[often], times[often]
    other, _, m, other_total = _frequencies(ordinary)
    there = np.zeros(len(grams))
    if len(other):
        at = np.minimum(np.searchsorted(other, grams), len(other) - 1)
        there = np.where(other[at] == grams, m[at], 0)
    log_ratio = np.log(times / (total + 1)) - np.log((there + UNSEEN) / (other_total + 1))
    keep = log_ratio > np.log(ratio)
    return grams[keep], log_ratio[keep]


def marked_spans(text: bytes, grams: np.ndarray, log_ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, largest log ratio) of each span of marked grams in the whole text."""
    places, values = [np.zeros(0, np.int64)], [np.zeros(0)]
    for begin in range(0, len(text) if len(grams) else 0, PIECE):
        found = _grams(text[begin : begin + PIECE + GRAM - 1])
        at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
        hit = np.flatnonzero(grams[at] == found)
        places.append(hit + begin)
        values.append(log_ratio[at[hit]])
    place, value = np.concatenate(places), np.concatenate(values)
    if not len(place):
        return place, place, value
    first = np.flatnonzero(np.concatenate([[True], np.diff(place) > 1]))
    last = np.concatenate([first[1:], [len(place)]]) - 1
    return place[first], place[last] + GRAM, np.maximum.reduceat(value, first)


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained zstandard dictionary; of too little text to train one, the text itself."""
    import zstandard as zs

    pieces = [s[i : i + WINDOW] for s in samples for i in range(0, len(s), WINDOW) if len(s) - i >= 8]
    try:
        return zs.train_dictionary(size, pieces).as_bytes()
    except zs.ZstdError:
        return b"".join(pieces)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + 0.1 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(bend, slope)
    return w


def train(toxic: list[str], ordinary: list[str], counts: tuple[int, int], *, size: int = 1 << 16, share: float = 0.1, ratio: float = 16.0) -> Model:
    """A model from labelled texts. ``counts``: how many toxic and ordinary rows there are in all, for the prior."""
    if not toxic or not ordinary:
        return Model()
    texts = [normalised(t) for t in [*toxic, *ordinary]]
    bad = np.arange(len(texts)) < len(toxic)
    profile = profiles(texts)
    centres = grouped(profile, bad)
    group = nearest(profile, centres)

    def of(rows: np.ndarray) -> Model:
        """A model, without weights, of some of the rows."""
        chosen = lambda which: [texts[i] for i in np.flatnonzero(which & rows)]
        marks = [toxic_grams(chosen(bad & (group == j)), chosen(~bad & (group == j)), share, ratio) for j in range(len(centres))]
        return Model(_dictionary(chosen(~bad), size), _dictionary(chosen(bad), size), centres=centres, marks=marks)

    third = np.concatenate([np.arange(len(toxic)), np.arange(len(ordinary))]) % 3
    inputs = np.zeros((len(texts), 5 + 2 * len(centres)))
    for r in np.unique(third):
        inputs[third == r] = of(third != r).inputs([texts[i] for i in np.flatnonzero(third == r)])
    prior = np.where(bad, counts[0] / len(toxic), counts[1] / len(ordinary))
    model = of(np.ones(len(texts), bool))
    model.weights = _logistic(inputs, bad.astype(float), prior / prior.mean())
    return model


def fit(documents: DataFrame, labels: DataFrame, *, per_class: int = 1500, modulus: int = 5, held_remainder: int = 0) -> Model:
    """Train on at most ``per_class`` labelled rows of each kind, none of them held out."""
    kinds = labels.where(F.col("toxic").isin(0, 1)).where(common.id_remainder("doc_id", modulus) != held_remainder).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample, counts = common.sampled_by_class(kinds, "toxic", per_class)
    rows = common.training_texts(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id"), "toxic")
    texts = lambda kind: [r["text"] for r in rows if r["toxic"] == kind]
    return train(texts(1), texts(0), (counts.get(1, 0), counts.get(0, 0)))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row's whole text."""
    import pyarrow as pa

    def scored(batches: Iterator) -> Iterator:
        for batch in common.byte_batches(batches, 1 << 20):
            values = model.scores(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("doc_id"), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return common.in_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scored, "doc_id long, score double")


def keep(documents: DataFrame, model: Model, *, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents``, with all their columns, that score below the threshold."""
    return common.kept_rows(documents, lambda texts: model.scores(texts.to_pylist()) < threshold)


def classify(documents: DataFrame, labels: DataFrame, *, threshold: float = 0.5, modulus: int = 5, held_remainder: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    model = fit(documents, labels, modulus=modulus, held_remainder=held_remainder)
    return score(documents, model).select("doc_id", (common.id_remainder("doc_id", modulus) == held_remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
