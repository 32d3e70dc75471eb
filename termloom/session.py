"""Session settings that the library is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed joins and merges small partitions; zstd keeps shuffle and tables small.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # look-ups by locator name up to this many in the scan (planner.NAMED)
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows of very long texts: batches for Python are bounded in bytes too
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


def session(master: str | None = None, app_name: str = "termloom", **more: str) -> SparkSession:
    """A session with the library's settings; ``more`` takes keys with ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
