"""Incremental index builds with Structured Streaming.

Each micro-batch of comments appends its postings and document lengths under a
folder of its own batch number, so a batch that is run again after a failure
replaces what it wrote before. Lexicon and corpus sizes are sums over all batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from termloom.functions.analysis import PLAIN, Analyzer
from termloom.operators import index as ix


def append_batch(batch: DataFrame, batch_id: int, path: str, analyzer: Analyzer = PLAIN) -> None:
    tokens = ix.tokenised(batch, analyzer)
    for name, df in (("comments", batch.sortWithinPartitions("locator")), ("doc_stats", ix.doc_stats_of(tokens).sortWithinPartitions("locator")), ("postings", ix.postings_of(tokens).sortWithinPartitions("term", "locator"))):
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")


def start(comments: DataFrame, path: str, checkpoint: str, analyzer: Analyzer = PLAIN, **trigger) -> StreamingQuery:  # noqa: ANN003
    """Keeps the index under ``path`` up to date with a stream of (locator, cid, text)."""
    return comments.writeStream.foreachBatch(lambda df, n: append_batch(df, n, path, analyzer)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def load(spark: SparkSession, path: str, analyzer: Analyzer = PLAIN) -> ix.Index:
    """The index over all batches so far."""
    tables = {n: spark.read.parquet(f"{path}/{n}").drop("batch") for n in ("comments", "postings", "doc_stats")}
    stats = ix.corpus_stats_of(tables["doc_stats"]).first()
    return ix.Index(analyzer, tables["comments"], tables["postings"], ix.lexicon_of(tables["postings"]), tables["doc_stats"], None, stats["c"], stats["n_docs"])
