"""Helpers shared by the training-data operators.

The rest of the library doesn't depend on this subpackage, which can be removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.storage import stored  # noqa: F401  (for the operators)

#: Fixed value: a word of the shared word contracts, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed value: what separates such words.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else changed."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once for each row.

    A column used inside a higher-order function may be merged into it by the
    optimiser and then be computed for each element; a lambda variable can't be.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; a null text has none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD)

    def inner(p: Column) -> Column:
        # only the first and the last part can be empty; a slice is much cheaper than a filter
        first = (F.get(p, F.lit(0)) == "").cast("int")
        last = ((F.get(p, F.size(p) - 1) == "") & (F.size(p) > 1)).cast("int")
        return F.slice(p, first + 1, F.size(p) - first - last)

    return let(parts, inner)


def each_copy(df: DataFrame, copies: str) -> DataFrame:
    """Each row of ``df`` as many times as its column ``copies`` says, without that column."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop("_copy", copies)


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


#: Bound on broadcast ids or row keys, about 100 bytes each once they are hashed.
BROADCAST_IDS = 500_000


def bounded(ids: DataFrame) -> DataFrame:
    """``ids`` (a stored table) marked for broadcast if they are few, else as they are, for a shuffle join."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def text_hash(text: str = "text") -> Column:
    """With the id, what tells a row: rows that agree in both hold one text under one id."""
    return F.xxhash64(F.col(text).cast("string"))


def stored_few(df: DataFrame, rows: int, per_file: int = 200_000) -> DataFrame:
    """``df``, of at most ``rows`` narrow rows, stored in no more files than these fill."""
    return stored(df.coalesce(max(1, -(-rows // per_file))))


def without(df: DataFrame, rows: DataFrame) -> DataFrame:
    """``df`` (doc_id, text, ...) without the rows named by ``rows`` (doc_id, text_hash); a null id is an id like others."""
    gone = bounded(stored(rows.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()))
    return df.join(gone, df["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (text_hash() == F.col("_hash")), "left_anti").select(df.columns)


#: Rows of an Arrow batch. Batches of the default 10,000 rows of text take tens of MB on both sides.
BATCH_ROWS = 1000


def in_arrow(df: DataFrame, function: Callable[[Iterator], Iterator], schema: Any) -> DataFrame:
    """``df.mapInArrow`` in small batches, by workers that give freed memory back to the system."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def lean(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(-3, 1 << 20)  # arrays of over 1 MB are given back as soon as they are freed
        except (OSError, AttributeError):  # another C library
            libc = None
        yield from function(batches)
        pa.default_memory_pool().release_unused()
        if libc:
            libc.malloc_trim(0)

    return df.mapInArrow(lean, schema)


def kept_rows(df: DataFrame, keep: Callable[[Any], Any], limit: int = 1 << 20) -> DataFrame:
    """The rows of ``df`` for which ``keep``, given the Arrow column ``text`` of some rows, says so; one pass, no join."""

    def passed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in byte_batches(batches, limit):
            yield batch.filter(pa.array(keep(batch.column("text")), pa.bool_()))

    return in_arrow(df, passed, df.schema)


#: Bound on the text that training collects, in bytes, whatever the rows hold.
TRAINING_BYTES = 64 << 20


def sampled_by_class(rows: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict]:
    """At most ``per_class`` different ids (doc_id, label) of each value of ``label``: those first by a hash.

    Returns the sample, a stored table, and the row count of each value. A filter on the hash
    leaves few more than needed, in one pass without a shuffle; of these the first are taken.
    Values beyond 1,000 distinct ones are an error: a label is not a key.
    """
    rows = rows.select("doc_id", label)
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).limit(1001).collect()}
    if len(counts) > 1000:
        raise ValueError(f"{label} has over 1,000 values")
    keep, place = F.lit(False), F.xxhash64("doc_id", label)
    for value, n in counts.items():
        share = (per_class + 10 * per_class**0.5) / n  # ten standard deviations more, so that enough are left
        low = F.lit(True) if share >= 1 else place < int(share * 2**64) - 2**63
        keep = keep | ((F.col(label) == F.lit(value)) & low)
    first = Window.partitionBy(label).orderBy(place, "doc_id")
    return stored(rows.where(keep).distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_class).drop("_n")), counts


def training_texts(rows: DataFrame, label: str, *, most_bytes: int = TRAINING_BYTES) -> list:
    """(doc_id, label, text) of ``rows``, one for each (doc_id, label): of several texts the one with the least hash.

    ``rows`` are those of a bounded sample of ids. Lengths are added up first, in the
    order of the hash, and only texts within ``most_bytes`` are collected (one at least).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.select("doc_id", label, text.alias("text"), F.xxhash64(text).alias("h"))
    found = rows.groupBy("doc_id", label).agg(F.min(F.struct("h", F.octet_length("text").alias("bytes"))).alias("t")).select("doc_id", label, "t.*").collect()
    kept, total = [], 0
    for r in sorted(found, key=lambda r: (r["h"], r["doc_id"])):
        total += r["bytes"]
        if total > most_bytes and kept:
            break
        kept.append((r["doc_id"], r["h"]))
    if not kept:
        return []
    wanted = F.broadcast(rows.sparkSession.createDataFrame(kept, "doc_id long, h long"))
    out = rows.join(wanted, ["doc_id", "h"]).dropDuplicates(["doc_id", label, "h"]).select("doc_id", label, "text").collect()
    return sorted(out, key=lambda r: (r["doc_id"], str(r[label])))


def byte_batches(batches: Iterator, limit: int) -> Iterator:
    """Record batches cut into row ranges of about ``limit`` text bytes (column ``text``), one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.binary_length(batch.column("text").fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            yield batch.slice(low, high - low)
            low = high
