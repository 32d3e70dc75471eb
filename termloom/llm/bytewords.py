"""Words, n-grams and their hashes over whole columns of text, as numpy arrays.

A column of texts is one byte array and an offset for each row. Words and their
64-bit polynomial hashes come from prefix sums modulo 2**64, so no Python object
is made for a word.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_bytes = np.arange(256)
TO_LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes).astype(np.uint8)
#: The shared word contract: digits, lower-case letters and all bytes above ASCII.
IS_WORD = ((_bytes >= 48) & (_bytes <= 57)) | ((_bytes >= 97) & (_bytes <= 122)) | (_bytes >= 128)


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: np.uint64) -> np.ndarray:
        out = np.ones(n + 1, np.uint64)
        out[1:] = base
        return np.multiply.accumulate(out)

    with np.errstate(over="ignore"):
        return of(_BASE), of(_INVERSE)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever it stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(1 << int(len(data)).bit_length())
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def runs(kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal non-zero ``kind``; a run never crosses a row."""
    n = len(kind)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.ones(n + 1, bool)
    edge[1:n] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = kind[at[:-1]] != 0
    return at[:-1][keep], at[1:][keep]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the words of the shared contract, each word's row, word count of each row)."""
    lower = TO_LOWER[data]
    starts, ends = runs(IS_WORD[lower].astype(np.uint8), offsets)
    row = np.searchsorted(offsets, starts, side="right") - 1
    return span_hashes(lower, starts, ends), row, np.bincount(row, minlength=len(offsets) - 1)


def ngrams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all n consecutive values of a row, their rows)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, row.dtype)
    with np.errstate(over="ignore"):
        out = np.zeros(count, np.uint64)
        for i in range(n):
            out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + count])
    whole = row[:count] == row[n - 1 :]
    return out[whole], row[:count][whole]


def row_sums(values: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=n_rows)
