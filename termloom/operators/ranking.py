"""Query likelihood with Dirichlet smoothing, and top-k."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MU = 1500.0
DIGITS = 6


@dataclass(frozen=True)
class ScoredTerm:
    """A query term that takes part in scoring; ``times`` is how often the query has it."""

    term: str
    cf: int
    times: int


def scored_terms(terms: list[str], lexicon: dict[str, tuple[int, int]], c: int, stop_share: float) -> list[ScoredTerm]:
    """Known terms that aren't stop terms. ``lexicon``: (cf, posting bytes) by term."""
    return [ScoredTerm(t, lexicon[t][0], n) for t, n in sorted(Counter(terms).items()) if t in lexicon and lexicon[t][1] <= c * stop_share]


def frequencies(postings: DataFrame, terms: list[ScoredTerm]) -> DataFrame:
    """(locator, doc_len, tf_0, tf_1, ...): one pass over the terms' postings."""
    hits = postings.where(F.col("term").isin([t.term for t in terms]))
    return hits.groupBy("locator").agg(F.max("doc_len").alias("doc_len"), *(F.sum(F.when(F.col("term") == t.term, F.col("tf")).otherwise(0)).alias(f"tf_{i}") for i, t in enumerate(terms)))


def likelihood(terms: list[ScoredTerm], c: int, mu: float = MU) -> Column:
    """Rounded score of a row with doc_len and tf_i (null: 0)."""
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = F.coalesce(F.col(f"tf_{i}"), F.lit(0))
        score = score + t.times * F.log((tf + F.lit(mu * t.cf / c)) / (F.col("doc_len") + F.lit(mu)))
    return F.round(score, DIGITS)


def rank(candidates: DataFrame, postings: DataFrame, terms: list[ScoredTerm], c: int, mu: float = MU) -> DataFrame:
    """(locator, score) of candidates (locator, doc_len)."""
    if not terms:
        return candidates.select("locator", F.lit(0.0).alias("score"))
    tf = frequencies(postings, terms).drop("doc_len")
    return candidates.join(tf, "locator", "left").select("locator", likelihood(terms, c, mu).alias("score"))


def top(scored: DataFrame, k: int | None) -> DataFrame:
    """The k best; of equal scores the larger locators."""
    ordered = scored.orderBy(F.desc("score"), F.desc("locator"))
    return ordered if k is None else ordered.limit(k)


def top_each(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query_id, with their rank."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("locator"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def first_n(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
