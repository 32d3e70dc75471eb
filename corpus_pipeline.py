"""Corpus preparation: toxicity, language, near-duplicates, benchmark leaks, packing.

Each stage is a function of (spark, docs, sf_dir) that works on all that its
predecessor kept. All but the last return the columns of ``documents``; the last
returns the packing plan of the documents that are left.

Each row is a document of its own, also where ids repeat or are null: every stage
decides on a row by its text, and what it decides holds for rows with a null id too.
A null or empty text passes the toxicity stage, is dropped by the language stage, as
it holds no letter, and would pass the later ones. Rows that repeat with id and text
are told alike; the near-duplicate stage keeps one of them. Very long texts are taken
whole. Empty tables give empty results. Columns beside doc_id, text and lang are
handed on and never looked at, whatever their names; names that begin with an
underscore are kept for the stages' own use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import decontam, langid, neardup, packing, toxicity
from termloom.llm.common import stored, table
from termloom.llm.queries import tokenizer_path

#: A language prediction below this share of the posterior is rejected.
LEAST_SHARE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents predicted to be toxic; the classifier learns from labels of the documents at hand."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold no letter or whose language is a toss-up."""
    return langid.keep(docs, langid.fit(docs), least_share=LEAST_SHARE)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class one row: that with the smallest id."""
    return neardup.representatives(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of any benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_each_class),
    ("decontamination", drop_leaked),
    ("packing", pack),
]

#: No stage but decontamination can be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
