"""A prefix code for text: derivation from character counts, encoding and decoding.

Encoded text begins with 1 to 8 padding bits, ones and then a zero, so that it fills
whole bytes. Tables are stored as Parquet; this codec serves exchange with that
layout, and tests of the stored sizes that the index counts.
"""

from __future__ import annotations

import heapq
from itertools import count


def derive(frequencies: dict[str, int]) -> dict[str, str]:
    """The code of each symbol, from its count; deterministic for equal counts."""
    order = count()
    heap = [(n, next(order), [s]) for s, n in sorted(frequencies.items())]
    codes = dict.fromkeys(frequencies, "")
    if len(heap) == 1:
        return dict.fromkeys(frequencies, "0")
    heapq.heapify(heap)
    while len(heap) > 1:
        (n0, _, zero), (n1, _, one) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, side in (("0", zero), ("1", one)):
            for s in side:
                codes[s] = bit + codes[s]
        heapq.heappush(heap, (n0 + n1, next(order), zero + one))
    return codes


def encode(text: str, codes: dict[str, str]) -> bytes:
    bits = "".join(map(codes.__getitem__, text))
    padding = 8 - len(bits) % 8
    bits = "1" * (padding - 1) + "0" + bits
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def decode(data: bytes, codes: dict[str, str]) -> str:
    bits = f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}"
    symbols = {code: s for s, code in codes.items()}
    out, at, end = [], bits.index("0") + 1, bits.index("0") + 2
    while end <= len(bits):
        if bits[at:end] in symbols:
            out.append(symbols[bits[at:end]])
            at = end
        end += 1
    if at != len(bits):
        raise ValueError("the data end within a code")
    return "".join(out)


#: Distinct characters that a code may have.
MOST_SYMBOLS = 200_000


def code_table(df, column: str) -> dict[str, str]:  # noqa: ANN001
    """The code derived from a text column; its characters, not its rows, come to the driver. Too many are an error."""
    from termloom.operators.index import char_frequencies

    counts = char_frequencies(df, column).limit(MOST_SYMBOLS + 1).collect()
    if len(counts) > MOST_SYMBOLS:
        raise ValueError(f"{column} has over {MOST_SYMBOLS} different characters")
    return derive({r["ch"]: r["n"] for r in counts})
