"""Analyzers: from a text to its terms in order.

``plain`` takes lower-cased runs of letters and digits, in the JVM. ``english``
lower-cases, splits sentences, separates punctuation and stems each token; stems
come from an Arrow UDF over token arrays with a memory of the stems of its process,
so no shuffle by token is needed. Its sentence splitting is a plain rule (a final
stop followed by white space), not a trained model.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.porter2 import remembered, stem

#: Terms of other lengths are counted in document lengths and positions, but not indexed.
SHORTEST, LONGEST = 2, 126


def plain_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _holds(*marks: str) -> Callable[[Column], Column]:
    return lambda sentence: reduce(or_, (F.contains(sentence, F.lit(m)) for m in marks))


def _beyond_ascii(sentence: Column) -> Column:
    return F.octet_length(sentence) != F.char_length(sentence)


# Separations in order, each with a quick test of the sentences that it may change; the last full stop of
# a sentence stands alone, others stay.
SEPARATIONS = (
    (r"\xa0", " ", _beyond_ascii),
    (r"([;!\"\])}?%(\[{]|,(?![0-9]))", r" $1 ", None),
    (r"([،؛¿»›”؟¡٪°±©®।॥…“‘„‚«‹「『])", r" $1 ", _beyond_ascii),
    (r"(?<![/0-9a-z])(:)|(:)(?![/0-9a-z])", r" : ", _holds(":")),
    (r"(?<= )(')|(')(?=\s|$)", r" ' ", _holds("'")),
    (r"(--+|\.\.+)", r" $1 ", _holds("--", "..")),
    (r"(?<=\S)\.(?=\s*$)", r" .", _holds(".")),
)


def english_raw_tokens(text: Column) -> Column:
    """Lower-cased tokens, punctuation marks among them, before stemming."""
    sentences = F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+", -1)

    def separation(pattern: str, to: str, may_change: Callable[[Column], Column] | None) -> Callable[[Column], Column]:
        def of(sentence: Column) -> Column:
            separated = F.regexp_replace(sentence, pattern, to)
            return F.when(may_change(sentence), separated).otherwise(sentence) if may_change else separated

        return of

    for one in SEPARATIONS:
        sentences = F.transform(sentences, separation(*one))
    return F.flatten(F.transform(sentences, lambda s: F.filter(F.split(s, r"\s+", -1), lambda t: t != "")))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stemmed(tokens: pa.Array) -> pa.Array:
    # each different token of a batch once; remembered() lives in its module, so for as long as the worker's process
    offsets = tokens.offsets
    coded = tokens.flatten().dictionary_encode()
    stems = pa.array([remembered(t) for t in coded.dictionary.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(pc.subtract(offsets, offsets[0]), stems.take(coded.indices))


def english_tokens(text: Column) -> Column:
    return _stemmed(english_raw_tokens(text))


@dataclass(frozen=True)
class Analyzer:
    """``tokens`` makes an array of terms of a column; ``terms`` does the same for a query's words, on the driver."""

    name: str
    tokens: Callable[[Column], Column]
    term: Callable[[str], str]
    split: Callable[[str], list[str]]


def _plain_split(text: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def _english_split(text: str) -> list[str]:
    import regex

    out = []
    for sentence in regex.split(r"(?<=[.!?])\s+", text.lower()):
        for pattern, to, _ in SEPARATIONS:
            sentence = regex.sub(pattern, to.replace("$1", r"\1"), sentence)
        out += sentence.split()
    return out


PLAIN = Analyzer("plain", plain_tokens, str.lower, _plain_split)
ENGLISH = Analyzer("english", english_tokens, lambda w: stem(w.lower()), lambda t: [stem(x) for x in _english_split(t)])


def vector_tokens(text: Column) -> Column:
    """Tokens for document vectors: lower-cased letter runs of 2 to 15 characters."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"((?:(?!\d)[\p{L}\p{N}_])+)"), F.lit(1)), lambda t: F.length(t).between(2, 15))
