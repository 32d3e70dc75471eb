"""Approximate nearest neighbours by inner product: collision-counting hashing.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M a bound on the norms, and
a query a zero; then the largest inner product is the smallest distance. M is the norm
that few vectors (``TAIL``) exceed; these are verified for every query. Each of
``m`` random directions, in orthonormal frames, is one hash function: the block's projections on
it, sorted. A vector collides with a query in a direction if it lies in a window
centred on the query's own projection. Windows are widened step by step for all
directions at once (virtual rehashing; only the rings between two widths are
visited) until enough vectors collide in ``share`` of the directions. These are
verified with exact inner products. (Misses are counted instead of collisions: the
tails outside a wide window are shorter.)

Vectors are cut into blocks by a hash of their id, queries likewise; each pair of a
vector block and a query block is one unit of work of bounded memory, and gives the
block's best for each query; these are merged. The directions come from a fixed seed,
so nothing is fitted and every vector is indexed.

Defined cases: vectors that are null, all zero, or hold null, NaN or infinite
components take no part, nor do vectors of another dimension than the most common
one (of equally common ones the smaller); rows that share an id and repeat count
once, of different vectors the first by components; ties go to the smaller id; fewer
candidates than ``k`` give fewer rows; empty tables give none; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm import common

K = 20
#: Components of a vector block, and rows of a query block.
VECTOR_BLOCK, QUERY_BLOCK = 1 << 21, 1024
#: A candidate collides in ``SHARE`` of the directions; at least ``BETA`` of a block, and ``LEAST`` times k, are verified.
SHARE, BETA, LEAST = 0.8, 0.5, 16
#: Share of a block, the longest vectors, that is ranked exactly for every query.
TAIL = 0.05
#: Half widths begin at NARROW standard deviations and grow by GROWTH; after PILOTS queries they begin wider.
NARROW, GROWTH, PILOTS = 0.3, 1.07, 8


def directions(dim: int, m: int = 64, seed: int = 11) -> np.ndarray:
    """(dim + 1) x m directions: as many random orthonormal frames as it takes."""
    random, frames = np.random.default_rng(seed), []
    while sum(f.shape[1] for f in frames) < m:
        frames.append(np.linalg.qr(random.standard_normal((dim + 1, min(m, dim + 1))))[0])
    return np.concatenate(frames, axis=1)[:, :m].astype(np.float32)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, largest: float, k: int = K, *, share: float = SHARE, beta: float = BETA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vector id, score) of the best ``k`` found in the block for each query.

    The first queries begin with narrow windows; the others begin just below the
    narrowest width at which one of those ended.
    """
    n, dim = vectors.shape
    a = directions(dim)
    m = a.shape[1]
    wide = vectors.astype(np.float32)
    squares = (vectors.astype(np.float64) ** 2).sum(1)
    # a few very long vectors would make all others look alike: these are candidates of every query
    bound = np.quantile(squares, 1 - TAIL)
    always = squares > bound
    lift = np.sqrt(np.maximum(bound - squares, 0)).astype(np.float32)
    projected = wide @ a[:dim] + lift[:, None] * a[dim]
    order = np.argsort(projected, axis=0, kind="stable").T.copy()
    ordered = np.take_along_axis(projected.T, order, axis=1)
    centre = queries.astype(np.float32) @ a[:dim]
    unit = projected.std(axis=0) + 1e-9
    allowed, need = int((1 - share) * m), min(n, int(max(beta * n, LEAST * k)))
    sides: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def window(level: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of this level begin and end: queries x directions."""
        if level not in sides:
            half = NARROW * GROWTH**level * unit
            sides[level] = tuple(np.stack([np.searchsorted(ordered[j], centre[:, j] + s * half[j], side) for j in range(m)], axis=1) for s, side in ((-1, "left"), (1, "right")))
        return sides[level]

    def counted(low: np.ndarray, high: np.ndarray, outer_low: np.ndarray, outer_high: np.ndarray) -> np.ndarray:
        """In how many directions each vector lies between the outer and the inner window."""
        rings = [order[j, x:y] for j, ends in enumerate(zip(outer_low.tolist(), low.tolist(), high.tolist(), outer_high.tolist(), strict=True)) for x, y in (ends[:2], ends[2:])]
        return np.bincount(np.concatenate(rings), minlength=n)

    all_low, all_high = np.zeros(m, int), np.full(m, n)
    found: list[tuple] = []
    begin, ended = 0, []
    for q in range(len(query_ids)):
        if q == PILOTS:
            begin = max(0, min(ended) - 1)
        level = begin
        low, high = (x[q] for x in window(level))
        misses = counted(low, high, all_low, all_high)
        while np.count_nonzero(near := misses <= allowed) < need and (low.any() or (high < n).any()):
            level += 1
            wider_low, wider_high = (x[q] for x in window(level))
            misses = misses - counted(low, high, wider_low, wider_high)
            low, high = wider_low, wider_high
        ended.append(level)
        candidates = np.flatnonzero(near | always)
        candidates = candidates[ids[candidates] != query_ids[q]]
        if len(candidates) > k:
            rough = (wide @ queries[q].astype(np.float32))[candidates]
            # what is below the k-th by more than float32 products may err can't be among the best; NaN stays
            slack = 4 * (dim + 4) * 2.0**-24 * largest * np.linalg.norm(queries[q]) + dim * 1e-36
            candidates = candidates[~(rough < -np.partition(-rough, k - 1)[k - 1] - slack)]
        # component by component, as a matrix product may round equal vectors unequally, which would break ties
        score = np.zeros(len(candidates))
        for j in range(dim):
            score += vectors[candidates, j].astype(np.float64) * float(queries[q, j])
        best = np.lexsort((ids[candidates], -score))[:k]
        found.append((np.full(len(best), query_ids[q]), ids[candidates[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (size[0]["d"] if size else 0))
    again = common.stored(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if again.isEmpty():
        return rows
    some = common.bounded(again)
    # one vector of each id, taken within the input partitions first, so that an id of many rows meets in no task
    return rows.join(some, "id", "left_anti").unionByName(rows.join(some, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))


def _blocks(rows: DataFrame, count: int, size: int, name: str) -> DataFrame:
    """(block, ids, values): the rows of a block as two byte strings, one row for each block."""
    import pyarrow as pa

    blocks = max(1, -(-count // size))

    def packed(whole: pa.Table) -> pa.Table:
        ids = whole.column("id").to_numpy()
        values = np.stack(whole.column("v").to_numpy()).astype(np.float64)
        order = np.argsort(ids)
        return pa.table({name: whole.column(name)[:1].cast(pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "values": pa.array([values[order].tobytes()], pa.binary())})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy(name).applyInArrow(packed, f"{name} int, ids binary, values binary")


def nearest(table: DataFrame, id_column: str, vector_column: str, is_query, *, k: int = K) -> DataFrame:
    """(query_id, rank, id, score): for each row with ``is_query`` (a function of the id column) its ``k`` nearest others."""
    import pyarrow as pa

    rows = usable(table, id_column, vector_column)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(is_query(F.col("id")).cast("long")), F.lit(0)).alias("q"), F.max(norm).alias("m"), F.max(F.size("v")).alias("d")).first()
    dim, largest = stats["d"] or 1, stats["m"] or 0.0
    block_rows = max(1024, VECTOR_BLOCK // dim)
    queries = _blocks(rows.where(is_query(F.col("id"))), stats["q"], QUERY_BLOCK, "qb").withColumnsRenamed({"ids": "q_ids", "values": "q_values"})
    n_query_blocks = max(1, -(-stats["q"] // QUERY_BLOCK))
    cells = _blocks(rows, stats["n"], block_rows, "vb").withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    cells = cells.join(queries, "qb").repartition(max(1, -(-stats["n"] // block_rows)) * n_query_blocks, "vb", "qb")

    def searched(batches: Iterator) -> Iterator:
        for batch in batches:
            for row in batch.to_pylist():
                ids, q_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                found = search_block(ids, np.frombuffer(row["values"]).reshape(-1, dim), q_ids, np.frombuffer(row["q_values"]).reshape(-1, dim), largest, k)
                yield pa.record_batch([pa.array(x) for x in found], names=["query_id", "id", "score"])

    found = cells.select("ids", "values", "q_ids", "q_values").mapInArrow(searched, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
