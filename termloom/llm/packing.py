"""Packing of token sequences by linear grouping.

Texts are tokenised and cut into pieces of at most ``capacity`` tokens. Lengths are
whole numbers up to the capacity, so all there is to plan is a histogram of at most
``capacity`` counts, however many documents there are:

1. Large lengths, over capacity / ``large_share``, are put in order and divided into
   groups of equal cardinality; each length is rounded up to its group's largest.
2. Configurations of these few sizes that fill a sequence are optimised by column
   generation: a linear programme over configurations, priced by a knapsack.
3. The actual documents take their group's slots, which gives back the rounding.
4. What is left of the large ones, then the small ones, are placed best-fit, longest
   first, in the room that remains, opening sequences where none is left.

The plan is a list of runs (length, first rank, count, first sequence, offset), again
bounded by the capacity. Each piece gets a rank among the pieces of its length,
counted over hashed buckets so that a length held by a third of all pieces is
spread, and looks up its place.

Defined cases: a null or empty text is its end token alone; equal texts are packed
like others; an empty table packs to nothing; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm import common

CAPACITY = 4096
END_ID = 1
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Entries kept of the word cache of a Python worker, about 250 bytes each, where a caller names no other number.
CACHED = 100_000
#: How byte-level vocabularies write a byte: printable ones as they are, others as characters from 256 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_LEVEL = {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


#: Fixed value: the rule by which the vocabulary file divides texts into parts that it never joins.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-case ASCII: words, digits and runs of marks.
ASCII_UNITS = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")
VISIBLE = re.compile(rb"[!-~]+")
#: Characters up to U+023F; letters among them have one form each.
LATIN = re.compile(rb"(?:[a-z]|[\xc3-\xc8][\x80-\xbf])+")


class WordIds(dict):
    """Token ids, as little-endian bytes, of the white-space separated parts of texts.

    The tokenizer never joins across white space, so the ids of a text are those of
    its parts. A part of lower-case letters alone is one word to the vocabulary's
    model and goes there at once; a stop or comma after a letter is a token of its
    own; other ASCII parts are divided into words, digits and marks, each kept on its
    own; all else goes through the whole tokenizer.

    Parts are kept in two halves: when the newer is full it becomes the older, whose
    parts come back as they are met, so frequent parts stay.
    """

    def __init__(self, path: str, cached: int = CACHED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.word = self.tokenizer.model.tokenize
        says = json.loads(self.tokenizer.to_str())
        rules, forms = (json.dumps(says[k], ensure_ascii=False) for k in ("pre_tokenizer", "normalizer"))
        #: Texts of vocabularies of other rules go through the tokenizer whole.
        self.by_parts = json.dumps(RULE, ensure_ascii=False) in rules and '"Lowercase"' in forms
        self.half = max(1, cached // 2)
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, part: bytes) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.ids_of(part)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def ids_of(self, part: bytes) -> bytes:
        if part.isalpha() and part.islower():  # of bytes: ASCII letters
            return array("I", [t.id for t in self.word(part.decode())]).tobytes()
        if part[-1:] in b".," and part[-2:-1].isalpha():
            return self[part[:-1]] + self[part[-1:]]
        if LATIN.fullmatch(part) and (text := part.decode()).isalpha() and text == text.lower():
            return array("I", [t.id for t in self.word(part.decode("latin-1").translate(BYTE_LEVEL))]).tobytes()
        if VISIBLE.fullmatch(part) and b"<|" not in part and part == part.lower():
            units = ASCII_UNITS.findall(part)
            if len(units) > 1:
                return b"".join([self[u] for u in units])
        return array("I", self.tokenizer.encode_batch_fast([part.decode("utf-8", "replace")], add_special_tokens=False)[0].ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        raw = (text or "").encode("utf-8", "replace")
        if not self.by_parts:
            return array("I", self.tokenizer.encode_batch_fast([raw.decode()], add_special_tokens=False)[0].ids).tobytes()
        # Lower-casing ASCII first makes fewer distinct parts; marks like <|...|> are told by case.
        return b"".join(map(self.__getitem__, (raw if b"<|" in raw else raw.lower()).split()))


@lru_cache(maxsize=2)
def _word_ids(path: str, cached: int) -> WordIds:
    """One cache for all tasks of a worker process."""
    if sys.byteorder != "little" or array("I").itemsize != 4:
        raise RuntimeError("ids are kept as little-endian 32-bit numbers")
    return WordIds(path, cached)


def pieces(documents: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, cached: int = CACHED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and end id, cut at ``capacity``.

    ``tokenizer`` is the path of a vocabulary file that every executor has.
    """
    import pyarrow as pa

    def cut(batches: Iterator) -> Iterator:
        words, last = _word_ids(tokenizer, cached), np.array([end_id], "<u4").tobytes()
        for batch in common.byte_batches(batches, 1 << 20):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = words.encode(text) + last
                out += [(doc, n, at // 4, min(capacity, (len(ids) - at) // 4), zlib.crc32(ids[at : at + 4 * capacity])) for n, at in enumerate(range(0, len(ids), 4 * capacity))]
            doc, n, start, length, crc = zip(*out, strict=True)
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(n, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return common.in_arrow(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), cut, PIECE)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Whole multiples of configurations (a count of each size), from the linear programme; demand is never exceeded.

    Sizes are over capacity / 8 or so, so a configuration holds few of them.
    """
    m = len(sizes)
    if not m:
        return []
    basis = [tuple(capacity // sizes[i] if j == i else 0 for j in range(m)) for i in range(m)]
    want, width = np.array(demand, float), np.array(sizes)
    matrix = np.array(basis, float).T
    for _ in range(rounds):
        inverse = np.linalg.inv(matrix)
        price = np.ones(m) @ inverse
        best, used = _knapsack(width, price, capacity)
        if best <= 1 + 1e-7:
            break
        column = np.bincount(used, minlength=m).astype(float)
        level, change = inverse @ want, inverse @ column
        ratio = np.where(change > 1e-9, level / np.maximum(change, 1e-9), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        matrix[:, out] = column
        basis[out] = tuple(int(c) for c in column)
    levels = np.linalg.solve(matrix, want)
    left, plan = list(demand), []
    for config, level in sorted(zip(basis, levels, strict=True), key=lambda x: -x[1]):
        times = min([int(level + 1e-6), *(left[i] // c for i, c in enumerate(config) if c)])
        if times > 0:
            plan.append((config, times))
            left = [n - c * times for n, c in zip(left, config, strict=True)]
    return plan


def _knapsack(width: np.ndarray, price: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """Best value of items of these widths within the capacity, and the items; layer by layer of item count."""
    order = np.argsort(width)
    best = np.zeros(capacity + 1)
    took: list[np.ndarray] = []
    for _ in range(capacity // int(width.min())):
        nxt, choice = best.copy(), np.full(capacity + 1, -1)
        for i in order:
            w = int(width[i])
            value = best[: capacity + 1 - w] + price[i]
            better = value > nxt[w:] + 1e-12
            nxt[w:][better] = value[better]
            choice[w:][better] = i
        if (choice < 0).all():
            break
        took.append(choice)
        best = nxt
    room, used = int(best.argmax()), []
    for choice in reversed(took):
        if choice[room] >= 0:
            used.append(int(choice[room]))
            room -= int(width[choice[room]])
    return float(best.max()), used


def plan(histogram: dict[int, int], capacity: int = CAPACITY, *, large_share: int = 8, groups: int = 40) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset, copies in a sequence) that place all of the histogram."""
    left = {n: c for n, c in histogram.items() if c > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, sequences)
    keys: list[int] = []  # the rooms, sorted
    sequences = 0

    def put(n: int, first: int, times: int, used: int, copies: int = 1) -> None:
        runs.append((n, rank[n], times * copies, first, used, copies))
        rank[n] += times * copies
        left[n] -= times * copies

    def keep(room: int, first: int, times: int) -> None:
        if room and times:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(keys, room)
            rooms[room].append((first, times))

    large = sorted((n for n in left if n > capacity / large_share), reverse=True)
    total = sum(left[n] for n in large)
    members: list[list[list[int]]] = [[]]  # groups of [length, count], longest first
    share, filled = max(1, -(-total // groups)), 0
    for n in large:
        count = left[n]
        while count:
            take = min(count, share - filled)
            members[-1].append([n, take])
            filled, count = filled + take, count - take
            if filled == share:
                members.append([])
                filled = 0
    members = [g for g in members if g]
    sizes = [g[0][0] for g in members]
    merged: dict[int, list[list[int]]] = {}
    for size, g in zip(sizes, members, strict=True):  # groups of one rounded size count as one
        merged.setdefault(size, []).extend(g)
    sizes = list(merged)
    for config, times in configurations(sizes, [sum(c for _, c in merged[s]) for s in sizes], capacity):
        slots = [s for s, c in zip(sizes, config, strict=True) for _ in range(c)]
        while times:
            # as many sequences as hold the same actual lengths: of a size's slots each takes the group's next ones
            need = {s: slots.count(s) for s in slots}
            step, lengths = times, []
            for s, k in need.items():
                n, c = merged[s][0]
                if c >= k:
                    step, take = min(step, c // k), [(n, k)]
                else:
                    step, take, more = 1, [], k
                    for n, c in merged[s]:
                        take.append((n, min(c, more)))
                        more -= take[-1][1]
                        if not more:
                            break
                lengths.append((s, take))
            used = 0
            for s, take in lengths:
                for n, k in take:
                    put(n, sequences, step, used, k)
                    used += n * k
                    merged[s][0][1] -= step * k
                    if not merged[s][0][1]:
                        merged[s].pop(0)
            keep(capacity - used, sequences, step)
            sequences += step
            times -= step
    for n in sorted(left, reverse=True):
        while left[n]:
            at = bisect.bisect_left(keys, n)
            if at == len(keys):
                copies = min(left[n], capacity // n)
                times = left[n] // copies
                keep(capacity, sequences, times)
                sequences += times
                continue
            room = keys[at]
            first, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(at)
            copies = min(room // n, left[n])
            now = min(times, left[n] // copies)
            put(n, first, now, capacity - room, copies)
            keep(room - n * copies, first, now)
            keep(room, first + now, times - now)
    return runs


def ranked(cut: DataFrame, rows_per_bucket: int = 50_000) -> DataFrame:
    """``cut`` with ``rank``, the place from 0 among all pieces of its length; no task holds a whole length."""
    n = cut.count()
    buckets = max(1, -(-n // rows_per_bucket))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    per = dealt.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = per.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # the order among pieces of a length is free, but the same in each run
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    return dealt.withColumn("r", F.row_number().over(inside) - 1).join(bases, ["bucket", "length"]).withColumn("rank", F.col("base") + F.col("r")).drop("bucket", "base", "r")


def pack(documents: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID, cached: int = CACHED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece.

    ``cached`` bounds the word cache of a Python worker; it changes time and memory alone.
    """
    import pyarrow as pa

    cut = common.stored(pieces(documents, tokenizer, capacity=capacity, end_id=end_id, cached=cached))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = np.array(sorted(plan(histogram, capacity)), np.int64).reshape(-1, 6)
    # one number orders runs by length and first rank
    key = runs[:, 0] * (1 << 48) + runs[:, 1]
    shared = documents.sparkSession.sparkContext.broadcast((key, runs))

    def placed(batches: Iterator) -> Iterator:
        key, runs = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            nth, copies = rank - runs[at, 1], runs[at, 5]
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch([*columns, pa.array(runs[at, 3] + nth // copies), pa.array(runs[at, 4] + nth % copies * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return common.in_arrow(ranked(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), placed, f"{PIECE}, sequence_id long, offset long")
