"""Near-duplicate classes by DartMinHash.

A document is the set of its 5-word shingles (or, on request, their counts as
weights). Each shingle throws hashed darts, a Poisson process over ranks, into the
strips of its weight: [0, 1), [1, 2), [2, 4) and so on. A dart falls on one of
``k`` coordinates; of the darts below the shingle's weight each coordinate keeps the
earliest. Equal darts come from equal shingles, so two documents agree in a
coordinate with the probability of their weighted Jaccard similarity. Few darts are
needed: ranks are bounded by the document's total weight, and the bound is doubled
for a document with an empty coordinate. The similarity asked for is that of sets,
where every weight is 1; counts would lose pairs of which one repeats a passage.

Equal shingle sets are first taken together: a node. Signatures are cut into bands.
In each band bucket every node is compared with the bucket's smallest only, and
links give components: for most groups that is all. In buckets whose nodes are still
in different components, those outside of the bucket's largest component are
compared with all others: both sides are dealt into blocks of bounded size, each pair
of blocks is one unit of work with the nodes' shingles, and what no link has joined
yet is compared. It gives a link for each two components that it joins, never all
pairs. Components are closed over all links, so no class falls apart for a pair that
shares a bucket.

Comparisons are exact, by the shingles. Those with the smallest node first look at the
set sizes and at a sketch (4 bits of each coordinate); a pair that agrees in less than
``SKETCHED`` of the coordinates is over four standard deviations from a link.
Shingle sets are made once, for the nodes that share a bucket.

Buckets of over ``BLOCK`` nodes are few; they are broadcast (up to a checked
number) and never bring their nodes together in one task. A centre with very many
links is left to adaptive execution, which splits such joins.

Defined cases: rows are compared one by one. In ``classes`` rows that share an id
are one document, so their classes are one; a class is named by its smallest id, and
one of null ids alone has none. In ``representatives`` each row is a document, and of
a class the row with the smallest id (null last), then the smallest text hash, stays;
of rows that repeat one stays. Texts without words are each a class of their own; a
text of fewer than 5 words is one shingle; a very long text is taken whole, in memory
some 50 times its size; an empty table gives an empty result; other columns are
ignored or, in ``representatives``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import bytewords, common

SHINGLE = 5
BANDS, ROWS = 20, 5
#: Least share of agreeing coordinates of a pair that is compared exactly; at a similarity of 0.8 the mean is 0.81.
SKETCHED = 0.62
PLANES = 4
#: Nodes, and shingles, of a block of nodes that are compared at once.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Text bytes that a Python worker takes at once.
CHUNK = 1 << 19
_SALT = np.uint64(0xA24BAED4963EE407)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, count) of the different shingles of each row, by row and hash."""
    hashes, row, count = bytewords.words(data, offsets)
    parts = [bytewords.ngrams(hashes, row, n)]
    for short in range(1, n):
        mine = (count == short)[row]
        if mine.any():
            h, r = bytewords.ngrams(hashes[mine], row[mine], short)
            parts.append((bytewords.mixed(h + np.uint64(short)), r))
    h, r = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not len(h):
        return h.astype(np.uint64), r.astype(np.int64), np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(r[order], kind="stable")]
    h, r = h[order], r[order]
    heads = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]))
    return h[heads], r[heads], np.diff(np.append(heads, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_signatures(elements: np.ndarray, row: np.ndarray, weights: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """The earliest dart of each coordinate: n_rows x k; rows without weight stay 0."""
    out = np.zeros((n_rows, k), np.uint64)
    total = np.bincount(row, weights=weights, minlength=n_rows)
    todo = total > 0
    bound = np.where(todo, k * (np.log(k) + 3) / np.maximum(total, 1e-300), 0.0)
    while todo.any():
        mine = todo[row]
        keys, ranks, darts = _throw(elements[mine], row[mine], weights[mine], bound, k)
        order = np.lexsort((ranks, keys))
        keys, darts = keys[order], darts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        out.reshape(-1)[keys[first]] = darts[first]
        filled = np.bincount(keys[first] // k, minlength=n_rows)
        todo &= filled < k
        bound = np.where(todo, bound * 2, bound)
    return out


def _throw(elements: np.ndarray, row: np.ndarray, weights: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row * k + coordinate, rank, dart) of all darts below the bound of their row and the weight of their element."""
    found: list[tuple] = []
    low, high, strip = 0.0, 1.0, 0
    with np.errstate(over="ignore"):
        while len(elements):
            seed = bytewords.mixed(elements ^ (np.uint64(strip + 1) * _SALT))
            r, w, rank, n = row, weights, np.zeros(len(seed)), 0
            while len(seed):
                n += 1
                dart = bytewords.mixed(seed + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15))
                rank = rank - np.log(_uniform(dart)) / (high - low)
                on = rank < bound[r]
                seed, r, w, rank, dart = seed[on], r[on], w[on], rank[on], dart[on]
                place = bytewords.mixed(dart + _SALT)
                inside = low + (high - low) * _uniform(bytewords.mixed(place)) <= w
                found.append(((r * k + (place % np.uint64(k)).astype(np.int64))[inside], rank[inside], place[inside]))
            more = weights > high
            elements, row, weights = elements[more], row[more], weights[more]
            low, high, strip = high, high * 2, strip + 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
        for i in range(rows):
            out = bytewords.mixed(out * np.uint64(0xD6E8FEB86659FD93) + signatures[:, i : bands * rows : rows])
    return out.view(np.int64)


def sketches(signatures: np.ndarray) -> np.ndarray:
    """Bit planes of the lowest bits of each coordinate, as 64-bit words: n_rows x (PLANES * words)."""
    n, k = signatures.shape
    width = -(-k // 64) * 64
    bits = np.zeros((n, PLANES, width), np.uint8)
    for p in range(PLANES):
        bits[:, p, :k] = (signatures >> np.uint64(p)) & np.uint64(1)
    return np.packbits(bits.reshape(n, -1), axis=1).view(np.int64).reshape(n, -1)


def agreement(x: str, y: str, k: int) -> Column:
    """The share of coordinates in which two sketches agree."""
    words = -(-k // 64)
    differ = F.lit(0)
    for w in range(words):
        planes = [F.get(x, F.lit(p * words + w)).bitwiseXOR(F.get(y, F.lit(p * words + w))) for p in range(PLANES)]
        differ = differ + F.bit_count(reduce(lambda a, b: a.bitwiseOR(b), planes))
    return 1 - differ / k


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))


def signatures(documents: DataFrame, *, bands: int = BANDS, rows: int = ROWS, weighted: bool = False) -> DataFrame:
    """(doc_id, text_hash, a, b, n, bands, sketch): a set's two hashes and size, its band keys and its sketch (none without words)."""
    import pyarrow as pa

    def signed(batches: Iterator) -> Iterator:
        for batch in common.byte_batches(batches, CHUNK):
            n_rows = batch.num_rows
            h, row, count = shingles(*bytewords.column_bytes(batch.column("text")))
            n = np.bincount(row, minlength=n_rows)
            a, b = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
            with np.errstate(over="ignore"):
                once = bytewords.mixed(h + count.astype(np.uint64)) if weighted else h
                np.add.at(a, row, bytewords.mixed(once))
                np.add.at(b, row, bytewords.mixed(once ^ _SALT))
            s = dart_signatures(h, row, count.astype(float) if weighted else np.ones(len(h)), n_rows, bands * rows)
            lists = [_lists(band_keys(s, bands, rows), n > 0), _lists(sketches(s), n > 0)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n, pa.int64()), *lists], names=["doc_id", "text_hash", "a", "b", "n", "bands", "sketch"])

    return common.in_arrow(_texts(documents), signed, "doc_id long, text_hash long, a long, b long, n long, bands array<long>, sketch array<long>")


def _lists(values: np.ndarray, there: np.ndarray):
    """An Arrow list column: a row of ``values`` where ``there``, else an empty list."""
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum(np.where(there, values.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(values[there].reshape(-1), pa.int64()))


def sets_of(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """(node, set): the sorted different shingle hashes of the nodes (node, id, hash), read from one row of each; a stored table."""
    import pyarrow as pa

    def listed(batches: Iterator) -> Iterator:
        for batch in common.byte_batches(batches, CHUNK):
            h, row, _ = shingles(*bytewords.column_bytes(batch.column("text")))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            yield pa.record_batch([batch.column("node"), pa.ListArray.from_arrays(ends, pa.array(h.view(np.int64), pa.int64()))], names=["node", "set"])

    texts, wanted = _texts(documents), common.bounded(nodes)
    chosen = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["id"]) & (texts["text_hash"] == wanted["hash"])).select("node", "text")
    # a row may repeat
    return common.stored_few(common.in_arrow(chosen, listed, "node long, set array<long>").dropDuplicates(["node"]), nodes.count(), 5000)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (x, y) with their exact Jaccard ``similarity``."""
    x, y = sets.select(F.col("node").alias("x"), F.col("set").alias("sx")), sets.select(F.col("node").alias("y"), F.col("set").alias("sy"))
    shared = F.size(F.array_intersect("sx", "sy"))
    return pairs.join(y, "y").join(x, "x").select("x", "y", (shared / (F.size("sx") + F.size("sy") - shared)).alias("similarity"))


def on_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` joined with the stored table ``keys`` (key, members, ...) by ``key``; keys of many members are broadcast, so that none fills a task."""
    hot = common.bounded(common.stored_few(keys.where(F.col("members") > BLOCK), keys.count()))
    return rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(keys.where(F.col("members") <= BLOCK), "key"))


def components(edges: DataFrame, nodes: int) -> DataFrame:
    """(node, root): each node of the edges (x, y) with the smallest node of its component. There are ``nodes`` nodes at most.

    Alternates large-star and small-star steps; each writes its edges to the shared
    folder, and the count and hash sum tell when nothing changes.
    """
    edges = common.stored_few(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), BANDS * nodes)
    before, rows = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        large = common.stored_few(large, rows)
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x")
        small = small.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y"))).distinct()
        edges = common.stored_few(small, rows)  # a star step never makes more edges
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("x", "y")).alias("h")).first()
        if now == before:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
        before, rows = now, now["n"]


def joined_components(minor: list[tuple[int, int, np.ndarray]], every: list[tuple[int, int, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Links between ``minor`` and ``every`` (node, root, set) that join all components which similar sets of the two join."""
    node, root, sets = (list(x) for x in zip(*minor, *every, strict=True))
    _, group = np.unique(np.array(root), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    first = len(minor)
    others, other_starts, other_sizes = element[starts[first] :], starts[first:-1] - starts[first], sizes[first:]
    marked = np.zeros(element.max() + 1, bool)
    found = []
    for v in range(first):
        mine = element[starts[v] : starts[v + 1]]
        marked[mine] = True
        shared = np.add.reduceat(marked[others], other_starts, dtype=np.int64)
        marked[mine] = False
        for u in np.flatnonzero((shared >= threshold * (other_sizes + sizes[v] - shared)) & (group[first:] != group[v])) + first:
            if group[u] != group[v]:
                found.append((int(node[v]), int(node[u])))
                group[group == group[u]] = group[v]
    return found


def links_across(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (x, y) between components within buckets; ``members`` (key, node, n, root) is a stored table."""
    import pyarrow as pa

    of_root = members.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    major = F.max(F.struct("c", "root", "n"))
    keys = of_root.groupBy("key").agg(F.sum("c").alias("members"), F.sum("n").alias("shingles"), F.count("*").alias("roots"), major.alias("major")).where("roots > 1")
    blocks = lambda c, n: F.ceil(F.greatest(c / BLOCK, n / BLOCK_SHINGLES)).cast("int")
    keys = common.stored_few(keys.select("key", "members", F.col("major.root").alias("major"), blocks(F.col("members") - F.col("major.c"), F.col("shingles") - F.col("major.n")).alias("minor_blocks"), blocks(F.col("members"), F.col("shingles")).alias("all_blocks")), members.count())
    mixed = common.stored_few(on_keys(members, keys), members.count())

    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    minor = mixed.where("root <> major").select("key", place("minor_blocks").alias("i"), numbers("all_blocks").alias("j"), "node", "root", F.lit(True).alias("minor"))
    every = mixed.select("key", numbers("minor_blocks").alias("i"), place("all_blocks").alias("j"), "node", "root", F.lit(False).alias("minor"))
    whole = minor.unionByName(every).join(sets, "node")

    def compared(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("node").to_pylist(), table.column("root").to_pylist(), table.column("set").to_numpy(), strict=True))
        is_minor = table.column("minor").to_pylist()
        minor, every = ([r for r, m in zip(rows, is_minor, strict=True) if m == kind] for kind in (True, False))
        found = joined_components(minor, every, threshold) if minor and every else []
        return pa.table({"x": pa.array([x for x, _ in found], pa.int64()), "y": pa.array([y for _, y in found], pa.int64())})

    return common.stored(whole.groupBy("key", "i", "j").applyInArrow(compared, "x long, y long").distinct())


def _components_of(documents: DataFrame, threshold: float, bands: int, rows: int, unite: bool) -> tuple[DataFrame, DataFrame]:
    """Stored tables: the signed rows, and the nodes (a, b, id, hash, root); id and hash are of the first row. ``unite``: rows of one id are linked."""
    signed = common.stored(signatures(documents, bands=bands, rows=rows))
    worded = signed.where("n > 0")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("one")
    nodes = worded.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), one)
    # the numbers are fixed once the table is written
    nodes = common.stored(nodes.select(F.monotonically_increasing_id().alias("node"), "a", "b", "n", "bands", "sketch", F.col("one.doc_id").alias("id"), F.col("one.text_hash").alias("hash")))
    x, y = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "xy")
    alike = (F.least("nx", "ny") >= F.greatest("nx", "ny") * threshold - 1e-6) & (agreement("sx", "sy", bands * rows) >= SKETCHED)

    count = nodes.count()
    placed = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = common.stored_few(placed.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("members")).where("members > 1"), bands * count // 2)
    members = common.stored_few(on_keys(placed, shared).select("key", "node", "n", "center"), bands * count)
    known = common.stored_few(nodes.select("node", "id", "hash").join(members.select("node").distinct(), "node", "left_semi"), count)
    sets = sets_of(known, documents)
    stars = members.where("node <> center").select(F.col("center").alias("x"), F.col("node").alias("y")).distinct()
    stars = stars.join(y, "y").join(x, "x").where(alike).select("x", "y")
    first = components(similar(stars, sets).where(F.col("similarity") >= threshold).select("x", "y"), count)

    rooted = common.stored_few(members.join(first, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")), bands * count)
    more = links_across(rooted, sets, threshold)
    if unite:
        sets_of_id = worded.where("doc_id is not null").groupBy("doc_id").agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
        several = common.stored_few(sets_of_id.where("a0 <> a1 or b0 <> b1").select("doc_id"), count)
        if not several.isEmpty():
            of_id = worded.join(common.bounded(several), "doc_id").select("doc_id", "a", "b").distinct().join(nodes, ["a", "b"]).select("doc_id", "node")
            hub = of_id.groupBy("doc_id").agg(F.min("node").alias("x"))
            more = more.unionByName(of_id.join(hub, "doc_id").select("x", F.col("node").alias("y")))
    root = components(first.select(F.col("node").alias("x"), F.col("root").alias("y")).unionByName(more), count)
    return signed, common.stored_few(nodes.join(root, "node", "left").select("a", "b", "id", "hash", F.coalesce("root", "node").alias("root")), count)


def classes(documents: DataFrame, *, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) of each row of ``documents``."""
    signed, nodes = _components_of(documents, threshold, bands, rows, True)
    name = nodes.groupBy("root").agg(F.min("id").alias("class_id"))
    named = nodes.select("a", "b", "root").join(name, "root").select("a", "b", "class_id")
    return signed.select("doc_id", "a", "b", "n").join(named, ["a", "b"], "left").select("doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def representatives(documents: DataFrame, *, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of ``documents``, with all their columns, of which one of each class stays."""
    signed, nodes = _components_of(documents, threshold, bands, rows, False)
    best = nodes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "hash")).alias("best")).select("root", F.col("best.id").alias("best_id"), F.col("best.hash").alias("best_hash"))
    told = nodes.select("a", "b", "root").join(best, "root")
    is_best = F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("text_hash") == F.col("best_hash"))
    rows_told = signed.where("n > 0").select("doc_id", "text_hash", "a", "b").join(told, ["a", "b"]).select("doc_id", "text_hash", is_best.alias("is_best"))
    per = common.stored_few(rows_told.groupBy("doc_id", "text_hash").agg(F.first("is_best").alias("is_best"), F.count("*").alias("copies")).where("copies > 1 or not is_best"), signed.count())
    rest = common.without(documents, per)
    again = common.stored(per.where("is_best").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")))
    if again.isEmpty():
        return rest
    twice = documents.join(common.bounded(again), documents["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (common.text_hash() == F.col("_hash")))
    return rest.unionByName(twice.dropDuplicates(["_id", "_hash"]).select(documents.columns))
