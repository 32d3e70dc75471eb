"""The positional inverted index as ordinary tables.

A posting is one row (term, locator, positions). It carries its document's length,
so that scoring needs no join, and the number of bits that the reference layout's
prefix code spends on it, so that a term's stored size is a plain sum.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import storage
from termloom.functions.analysis import LONGEST, PLAIN, SHORTEST, Analyzer
from termloom.operators import grouping

#: Tokens whose postings make a range, which is sorted in memory and is one file; and postings sampled for its bounds.
TOKENS_A_RANGE, SAMPLED_A_RANGE = 1_500_000, 50


def code_bits(text: Column) -> Column:
    """Bits of digits and commas in the prefix code: 3 for 1, 2, 3 and the comma, 4 for others."""
    return 3 * F.length(text) + F.length(F.translate(text, "123,", ""))


def tokenised(comments: DataFrame, analyzer: Analyzer = PLAIN) -> DataFrame:
    """(locator, tokens)."""
    return comments.select("locator", analyzer.tokens(F.col("text")).alias("tokens"))


def _exploded(tokens: DataFrame) -> DataFrame:
    """Postings without tf and range, by a shuffle and a sort of token rows: joins the rows that share a locator and a length."""
    each = tokens.repartition("locator").select("locator", F.size("tokens").alias("doc_len"), F.posexplode("tokens").alias("pos", "term"))
    kept = each.where(F.length("term").between(SHORTEST, LONGEST))
    rows = kept.groupBy("term", "locator", "doc_len").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    stored = F.concat(F.col("locator").cast("string"), F.lit(","), F.array_join("positions", ","))
    return rows.select("term", "locator", "doc_len", "positions", (4 + code_bits(stored)).cast("long").alias("bits"))


def _range_bounds(tokens: DataFrame, n_tokens: int) -> list[tuple[str, int]]:
    """Pairs of term and locator that part postings into even ranges; chosen by a sample of tokens, as ranges of a sort are.

    Only the size of ranges hangs on the sample; every posting is in one.
    """
    ranges = -(-n_tokens // TOKENS_A_RANGE)
    if ranges < 2:
        return []
    documents = min(1.0, 20 * SAMPLED_A_RANGE * ranges / n_tokens)
    each = tokens.sample(documents, seed=1).select("locator", F.explode(F.array_distinct("tokens")).alias("term"))
    some = each.where(F.length("term").between(SHORTEST, LONGEST) & F.col("locator").isNotNull()).sample(min(1.0, SAMPLED_A_RANGE * ranges / (documents * n_tokens)), seed=2)
    pairs = sorted((r["term"], r["locator"]) for r in some.collect())
    return sorted({pairs[len(pairs) * i // ranges] for i in range(1, ranges)} if pairs else set())


def _postings(tokens: DataFrame, bounds: list[tuple[str, int]]) -> DataFrame:
    """Postings with the range between bounds that each belongs to."""
    base = (4 + code_bits(F.concat(F.col("locator").cast("string"), F.lit(",")))).cast("long")
    rows = lambda docs: grouping.grouped(docs.select("locator", "tokens", base.alias("bits")), SHORTEST, LONGEST, bounds)
    twice = tokens.groupBy("locator").agg(F.count("*").alias("n")).where("n > 1").select(F.col("locator").alias("shared"))
    if twice.isEmpty():
        found = rows(tokens)
    else:
        is_shared = F.col("locator").eqNullSafe(F.col("shared"))
        joined = _exploded(tokens.join(twice, is_shared, "left_semi")).withColumn("range", F.pmod(F.hash("term", "locator"), F.lit(len(bounds) + 1)))
        found = rows(tokens.join(twice, is_shared, "left_anti")).unionByName(joined)
    return found.select("term", "locator", "doc_len", F.size("positions").alias("tf"), "positions", "bits", "range")


def postings_of(tokens: DataFrame) -> DataFrame:
    """Postings of (locator, tokens). All tokens count in lengths and positions; only terms of fitting length are indexed.

    A document's tokens are grouped in its row; only rows that share a locator, which a
    first look at the locators tells, are grouped by a shuffle.
    """
    return _postings(tokens, []).drop("range")


def lexicon_of(postings: DataFrame) -> DataFrame:
    """(term, df, cf, posting_bytes); a stored line ends with 1 to 8 padding bits."""
    sums = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum("bits").alias("bits"))
    bits = F.col("bits") + code_bits(F.col("cf").cast("string"))
    return sums.select("term", "df", "cf", (F.floor(bits / 8) + 1).cast("long").alias("posting_bytes"))


def doc_stats_of(tokens: DataFrame) -> DataFrame:
    return tokens.select("locator", F.size("tokens").alias("doc_len"))


def corpus_stats_of(doc_stats: DataFrame) -> DataFrame:
    return doc_stats.agg(F.coalesce(F.sum("doc_len"), F.lit(0)).cast("long").alias("c"), F.count("*").alias("n_docs"))


def replies_of(comments: DataFrame) -> DataFrame:
    """(parent_cid, child_cid, child_locator), one row a reply."""
    return comments.where(F.col("parent_cid").isNotNull()).select("parent_cid", F.col("cid").alias("child_cid"), F.col("locator").alias("child_locator"))


def reply_index(comments: DataFrame) -> DataFrame:
    """(parent_cid, children): the sorted children of each comment that has some."""
    return replies_of(comments).groupBy("parent_cid").agg(F.array_sort(F.collect_list("child_cid")).alias("children"))


def cid_index(comments: DataFrame) -> DataFrame:
    """(cid, locator); of a cid that stands twice the later row."""
    return comments.groupBy("cid").agg(F.max("locator").alias("locator"))


def char_frequencies(df: DataFrame, column: str) -> DataFrame:
    """(ch, n): how often each character but the newline stands in a column."""
    ch = F.explode(F.split(F.coalesce(F.col(column), F.lit("")), ""))
    return df.select(ch.alias("ch")).where("ch <> '' and ch <> '\n'").groupBy("ch").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Index:
    """The index tables and the analyzer that made them; ``c`` and ``n_docs`` are the corpus's sizes."""

    analyzer: Analyzer
    comments: DataFrame
    postings: DataFrame
    lexicon: DataFrame
    doc_stats: DataFrame
    replies: DataFrame | None
    c: int
    n_docs: int


TABLES = ("comments", "postings", "lexicon", "doc_stats", "replies")


def build(comments: DataFrame, path: str, analyzer: Analyzer = PLAIN) -> Index:
    """Builds an index of (locator, cid, text[, parent_cid]) and writes its tables under ``path``.

    Postings and lexicon are ordered by term over ranges, so a look-up reads the
    row groups of its terms only; ranges are of term and locator, so the postings of
    a very frequent term are spread. Their number grows with the tokens, so that each
    is sorted in memory. Comments and lengths are ordered by locator inside
    each file, so that look-ups by locator skip pages, without a shuffle of the texts.
    Tokens are written once and read by all tables.
    """
    spark = comments.sparkSession
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    write(comments.sortWithinPartitions("locator"), "comments")
    tokens = storage.stored(tokenised(comments, analyzer))
    write(doc_stats_of(tokens).sortWithinPartitions("locator"), "doc_stats")
    bounds = _range_bounds(tokens, corpus_stats_of(read("doc_stats")).first()["c"])
    write(_postings(tokens, bounds).repartitionById(len(bounds) + 1, "range").drop("range").sortWithinPartitions("term", "locator"), "postings")
    write(lexicon_of(read("postings")).repartitionByRange("term").sortWithinPartitions("term"), "lexicon")
    if "parent_cid" in comments.columns:
        write(replies_of(comments).repartitionByRange("parent_cid", "child_cid").sortWithinPartitions("parent_cid", "child_cid"), "replies")
    return load(spark, path, analyzer, with_replies="parent_cid" in comments.columns)


def load(spark: SparkSession, path: str, analyzer: Analyzer = PLAIN, *, with_replies: bool = False) -> Index:
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES if name != "replies" or with_replies}
    stats = corpus_stats_of(tables["doc_stats"]).first()
    return Index(analyzer, tables["comments"], tables["postings"], tables["lexicon"], tables["doc_stats"], tables.get("replies"), stats["c"], stats["n_docs"])


def with_analyzer(index: Index, analyzer: Analyzer) -> Index:
    return replace(index, analyzer=analyzer)


def random_access(comments: DataFrame, locators: DataFrame) -> DataFrame:
    """Comments at given locators (column ``locator``); unknown ones give no row."""
    return comments.join(locators.select("locator").distinct(), "locator", "left_semi")


def by_cid(comments: DataFrame, cids: DataFrame) -> DataFrame:
    """Comments of given ids (column ``cid``); unknown ones give no row."""
    return comments.join(cids.select("cid").distinct(), "cid", "left_semi")
