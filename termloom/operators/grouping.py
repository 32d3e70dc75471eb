"""Tokens of documents grouped to postings, document by document, in Arrow arrays.

All tokens of a document are in its row, so grouping needs neither a shuffle nor a
sort of token rows: some documents at a time, their tokens are numbered by term and
sorted as integers.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Tokens grouped at a time by a worker; a longer document is grouped whole.
TOKENS_AT_ONCE = 500_000


def digit_bits(numbers: np.ndarray) -> np.ndarray:
    """Bits of the decimal digits of numbers from 0 in the prefix code: 3 for 1, 2 and 3, 4 for others."""
    rest, bits = numbers.astype(np.int64), np.zeros(len(numbers), np.int64)
    left = np.ones(len(rest), bool)
    while left.any():
        rest, digit = np.divmod(rest, 10)
        bits += np.where(left, 4 - ((digit >= 1) & (digit <= 3)), 0)
        left = rest > 0
    return bits


def _pieces(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` tokens, or one row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1, start + 1)
        yield start, min(end, n)
        start = end


def _range_of(terms: pa.Array, term_of: np.ndarray, locators: pa.Array, bounds: list[tuple[str, int]]) -> np.ndarray:
    """In which range between the sorted bounds each (term, locator) lies, of postings ordered by term; a term of some bounds is spread by locator."""
    firsts = [term for term, _ in bounds]
    several, names = set(firsts), terms.to_pylist()
    low = np.fromiter((bisect_left(firsts, t) for t in names), np.int32, len(names))
    ranges = low[term_of]
    for code in [i for i, t in enumerate(names) if t in several]:
        start, end = np.searchsorted(term_of, [code, code + 1])
        inner = np.array([locator for _, locator in bounds[low[code] : bisect_right(firsts, names[code])]], np.int64)
        at = pc.fill_null(locators.slice(start, end - start), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        ranges[start:end] += np.searchsorted(inner, at, "right").astype(np.int32)
    return ranges


def grouped(docs: DataFrame, shortest: int, longest: int, bounds: list[tuple[str, int]]) -> DataFrame:
    """Postings (term, locator, doc_len, positions, bits, range) of (locator, tokens, bits), one for each term of a row.

    ``bits`` are those of what a stored posting has beside its positions. ``bounds`` are
    sorted pairs of term and locator; ``range`` tells between which of them a posting lies.
    """
    locator_type = docs.schema["locator"].dataType
    schema = T.StructType(
        [T.StructField("term", T.StringType()), T.StructField("locator", locator_type), T.StructField("doc_len", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType())), T.StructField("bits", T.LongType()), T.StructField("range", T.IntegerType())]
    )

    def of_rows(locators: pa.Array, base: pa.Array, tokens: pa.Array, starts: np.ndarray) -> pa.RecordBatch:
        lengths = np.diff(starts)
        coded = tokens.dictionary_encode()
        terms, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        chars = pc.utf8_length(terms).to_numpy()
        places = np.flatnonzero(((chars >= shortest) & (chars <= longest))[codes])
        # by term, then by place: the order of rows, and of positions inside them
        n = max(len(codes), 1)
        term_of, place = np.divmod(np.sort(codes[places] * n + places), n)
        row = np.repeat(np.arange(len(lengths)), lengths)[place]
        position = (place - starts[row]).astype(np.int32)
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(term_of) != 0) | (np.diff(row) != 0)
        first = np.flatnonzero(new)
        term_of, row = term_of[first], row[first]
        cost = digit_bits(np.arange(position.max() + 1 if len(position) else 0))[position]
        sums = np.add.reduceat(cost, first) if len(first) else cost
        rows = pa.array(row)
        of_posting = locators.take(rows)
        commas = 3 * (np.diff(np.append(first, len(place))) - 1)
        arrays = [
            terms.take(pa.array(term_of)), of_posting, pa.array(lengths[row].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(first, len(place)).astype(np.int32)), pa.array(position)),
            pc.add(base.take(rows), pa.array(sums + commas)), pa.array(_range_of(terms, term_of, of_posting, bounds)),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            offsets = tokens.offsets.to_numpy().astype(np.int64)
            for start, end in _pieces(offsets, TOKENS_AT_ONCE):
                values = tokens.values.slice(offsets[start], offsets[end] - offsets[start])
                yield of_rows(batch.column("locator").slice(start, end - start), batch.column("bits").slice(start, end - start), values, offsets[start : end + 1] - offsets[start])

    return docs.select("locator", "tokens", "bits").mapInArrow(postings, schema)
