"""Benchmark decontamination by winnowing, with DataFrame functions only.

Texts are word lists. Of the hashes of all 4-word grams the smallest of every 5
consecutive ones is kept as a fingerprint, in documents and in benchmark items
alike. A shared run of 8 words holds 5 shared grams in a row, so both sides keep
the same smallest one: every shared run of 8 or more words is found. Fingerprints
are joined, the grams' words compared, and each match is extended to both sides by
up to 4 words; where 8 or more words agree, these are hit. Longer runs are covered
by their other fingerprints.

An item of fewer than 8 words is one window of its own length; such items are
found by the hashes of all document grams of that length.

The item fingerprints are counted. Up to ``broadcast_rows`` they are broadcast, and a
bit table of their hashes (16 bits for each, so about one other hash in 16 passes) is
looked up inside the row, so that only likely matches leave it, each with the 12
words around it: the cost of a text is linear in its length. Beyond that, narrow
fingerprints (id, hash of the text, place) are joined by shuffle, and the words of
documents that match are fetched afterwards. Both ways give the same rows.

Hits are gathered by (id, hash of the text, input partition), which stays the same
when a lost task runs again; rows that repeat are counted by their end markers.

Defined cases: null and empty texts have no words and are clean; an item without
words is never found; rows that repeat, also with the same id, are each reported; a
hit word counts once however many windows cover it; very long texts are read whole;
empty tables give empty or clean results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import common

GRAM, WINDOW = 4, 8
SIDE = WINDOW - GRAM
#: Bound on the broadcast fingerprints, about 300 bytes each.
BROADCAST_ROWS = 200_000
KEY = ("doc_id", "text_hash", "part")


def _gram_hashes(words: Column, length: int) -> Column:
    """The hash at each place where ``length`` words stand."""
    there = F.slice(words, F.lit(1), F.greatest(F.size(words) - (length - 1), F.lit(0)))
    return F.transform(there, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, length))))


def _least(grams: Column) -> Column:
    """The smallest hash of each full window."""
    full = F.slice(grams, F.lit(1), F.greatest(F.size(grams) - SIDE, F.lit(0)))
    return F.transform(full, lambda h, i: F.least(h, *(F.get(grams, i + j) for j in range(1, SIDE + 1))))


def _placed(hashes: Column, length: int, chosen) -> Column:  # noqa: ANN001
    """(length, p, hash) of the hashes that are ``chosen`` (of a hash and its place)."""
    kept = F.transform(hashes, lambda h, i: F.when(chosen(h, i), F.struct(F.lit(length).alias("length"), i.alias("p"), h.alias("hash"))))
    return F.filter(kept, lambda s: s.isNotNull())


def fingerprints(words: Column, passes=None) -> Column:  # noqa: ANN001
    """(length, p, hash) of the grams whose hash is the smallest of some window, and passes."""

    def largest(least: Column, i: Column) -> Column:
        return F.greatest(*(F.get(least, i - j) for j in range(SIDE, -1, -1)))

    def of(grams: Column, least: Column) -> Column:
        return _placed(grams, GRAM, lambda h, i: (h == largest(least, i)) & (passes(h) if passes else F.lit(True)))

    return common.let(words, lambda w: common.let(_gram_hashes(w, GRAM), lambda g: common.let(_least(g), lambda m: of(g, m))))


def bit_table(hashes: list[int]) -> list[int]:
    """A power of two of 64-bit words; 16 bits for each hash at least."""
    size = max(64, 1 << (16 * len(hashes) - 1).bit_length()) // 64 if hashes else 1
    words = [0] * size
    for h in hashes:
        at = h & (64 * size - 1)
        words[at >> 6] |= 1 << (at & 63)
    return [w - (1 << 64) if w >> 63 else w for w in words]


def looked_up(table: list[int]):  # noqa: ANN201
    """Whether the bit of a hash is set, as a function of the hash column."""
    # folded into one constant before the query runs
    words = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    mask = F.lit(64 * len(table) - 1).cast("long")

    def passes(h: Column) -> Column:
        at = h.bitwiseAND(mask)
        # shifts take the place modulo 64
        return F.call_function("shiftright", F.get(words, F.shiftright(at, 6).cast("int")), at.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    return passes


def _agreeing(pairs: list[Column]) -> Column:
    """How many of the pairs, from the first on, agree without a break."""
    out = F.lit(0)
    for same in reversed(pairs):
        out = F.when(same, out + 1).otherwise(0)
    return out


def item_fingerprints(items: DataFrame) -> DataFrame:
    """(length, hash, item_id, gram, left, right) of items (item_id, words); left is nearest first. Short items are one gram with empty sides."""
    long = items.where(F.size("words") >= WINDOW).select("item_id", "words", F.inline_outer(fingerprints(F.col("words")))).withColumnRenamed("p", "q")
    near = lambda *at: F.array(*(F.get("words", F.col("q") + j) for j in at))
    long = long.select(F.lit(GRAM).alias("length"), "hash", "item_id", near(*range(GRAM)).alias("gram"), near(*range(-1, -SIDE - 1, -1)).alias("left"), near(*range(GRAM, WINDOW)).alias("right"))
    no = F.array().cast("array<string>")
    for n in range(1, WINDOW):
        # lengths of short items are told from GRAM by their sign
        short = items.where(F.size("words") == n).select(F.lit(-n).alias("length"), F.xxhash64(*(F.get("words", F.lit(j)) for j in range(n))).alias("hash"), "item_id", F.col("words").alias("gram"), no.alias("left"), no.alias("right"))
        long = long.unionByName(short)
    return long.distinct()


def _candidates(w: Column, lengths: list[int], passes=None) -> Column:  # noqa: ANN001
    """(length, p, hash) of all places of a row that may match."""
    parts = [fingerprints(w, passes)] + [_placed(_gram_hashes(w, -n), n, (lambda h, i: passes(h)) if passes else (lambda h, i: F.lit(True))) for n in lengths if n < 0]
    return F.concat(*parts)


def _around(w: Column, p: Column) -> Column:
    """The words from SIDE before a place to WINDOW after it, as far as there are."""
    first = F.greatest(p - SIDE, F.lit(0))
    return F.slice(w, first + 1, p - first + WINDOW)


def _spans(matched: DataFrame) -> DataFrame:
    """(KEY, n_words, item_id, a, b): the verified hit spans [a, b) of matches with their words around; rows without a place stay."""
    at = F.least(F.col("p"), F.lit(SIDE))
    same = lambda j, column, k: F.coalesce(F.get("around", at + j) == F.get(F.col(column), F.lit(k)), F.lit(False))
    core = F.slice("around", at + 1, F.abs("length")) == F.col("gram")
    left = _agreeing([same(-1 - k, "left", k) for k in range(SIDE)])
    right = _agreeing([same(GRAM + k, "right", k) for k in range(SIDE)])
    found = matched.where(F.col("p").isNull() | core).withColumn("_l", left).withColumn("_r", right)
    found = found.where(F.col("p").isNull() | (F.col("length") < 0) | (F.col("_l") + F.col("_r") >= SIDE))
    return found.select(*KEY, "n_words", "item_id", (F.col("p") - F.col("_l")).cast("long").alias("a"), (F.col("p") + F.abs("length") + F.col("_r")).cast("long").alias("b"))


def hits(documents: DataFrame, benchmark: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(KEY, n_words, item_id, a, b): hit word spans, and one row without span for each row of ``documents``."""
    items = common.stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), common.words_of(F.col("text").cast("string")).alias("words")).where(F.size("words") > 0))
    prints = common.stored(item_fingerprints(items))
    lengths = [r["length"] for r in prints.select("length").distinct().collect()]  # GRAM, and at most 7 of short items
    few = prints.count() <= broadcast_rows
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.spark_partition_id().alias("part"), common.words_of(text).alias("words"))

    if few:
        passes = looked_up(bit_table([r["hash"] for r in prints.select("hash").distinct().collect()]))
        end = F.struct(F.lit(None).cast("int").alias("length"), F.lit(None).cast("int").alias("p"), F.lit(None).cast("long").alias("hash"), F.lit(None).cast("array<string>").alias("around"))

        def found(w: Column) -> Column:
            likely = F.transform(_candidates(w, lengths, passes), lambda s: F.struct(s["length"].alias("length"), s["p"].alias("p"), s["hash"].alias("hash"), _around(w, s["p"]).alias("around")))
            return F.struct(F.size(w).alias("n_words"), F.concat(F.array(end), likely).alias("found"))

        rows = docs.select(*KEY, common.let(F.col("words"), found).alias("f")).select(*KEY, F.col("f.n_words").cast("long").alias("n_words"), F.col("f.found").alias("found"))
        # outer, though no row is empty: else Spark puts a filter before it that computes the array once more
        placed = rows.select(*KEY, "n_words", F.inline_outer("found"))
        matched = placed.join(F.broadcast(prints), ["length", "hash"], "left")
        return _spans(matched.where(F.col("p").isNull() | F.col("item_id").isNotNull()))

    narrow = docs.select("doc_id", "text_hash", F.inline_outer(common.let(F.col("words"), lambda w: _candidates(w, lengths)))).where(F.col("p").isNotNull()).distinct()
    matches = common.stored(narrow.join(prints, ["length", "hash"]).drop("hash").withColumnsRenamed({"doc_id": "id", "text_hash": "th"}))
    same = docs["doc_id"].eqNullSafe(F.col("id")) & (docs["text_hash"] == F.col("th"))
    likely = docs.join(common.bounded(common.stored(matches.select("id", "th").distinct())), same, "left_semi")
    spelled = likely.join(matches, likely["doc_id"].eqNullSafe(F.col("id")) & (likely["text_hash"] == F.col("th")))
    spelled = spelled.select(*KEY, F.size("words").cast("long").alias("n_words"), "length", "p", "item_id", "gram", "left", "right", _around(F.col("words"), F.col("p")).alias("around"))
    ends = docs.select(*KEY, F.size("words").cast("long").alias("n_words"), *(F.lit(None).cast("long").alias(c) for c in ("item_id", "a", "b")))
    return _spans(spelled).unionByName(ends)


def _covered(spans: Column) -> Column:
    """How many places sorted spans cover."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def report(documents: DataFrame, benchmark: DataFrame, *, min_items: int = 2, **how) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document."""
    found = hits(documents, benchmark, **how)
    spans = F.array_sort(F.collect_set(F.when(F.col("a").isNotNull(), F.struct("a", "b"))))
    per = found.groupBy(*KEY).agg(F.max("n_words").alias("n_words"), F.collect_set("item_id").alias("_items"), spans.alias("_spans"), F.count_if(F.col("a").isNull()).alias("_copies"))
    per = common.each_copy(per, "_copies")
    joined = F.concat_ws(",", F.array_sort(F.transform("_items", lambda i: i.cast("string"))))
    n = F.size("_items").cast("long")
    return per.select("doc_id", "n_words", _covered(F.col("_spans")).alias("n_hit"), n.alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (n >= min_items).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``documents``, with all their columns, that hold no window of any item."""
    leaked = hits(documents, benchmark, **how).where(F.col("a").isNotNull()).select("doc_id", "text_hash")
    return common.without(documents, leaked)
