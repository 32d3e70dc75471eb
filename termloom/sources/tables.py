"""The test tables in the roles of a comment corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(locator, cid, text, source) from documents; an id is its own locator."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("locator"), F.col("doc_id").alias("cid"), "text", "source")


def thread_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(locator, cid, text, source, parent_cid) from conversations: each turn answers the one before."""
    cid = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(cid.alias("locator"), cid.alias("cid"), "text", F.col("role").alias("source"), F.when(F.col("turn") > 0, cid - 1).alias("parent_cid"))
