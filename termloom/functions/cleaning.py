"""Row cleaning of raw comment files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fullwidth punctuation and what replaces it.
FULLWIDTH = {
    "，": ", ",
    "！": "! ",
    "？": "? ",
    "；": "; ",
    "：": ": ",
    "（": " (",
    "）": ") ",
    "［": " [",
    "］": "] ",
    "【": " [",
    "】": "] ",
    "。": ". ",
}


def ascii_punctuation(text: Column) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), FULLWIDTH.items(), text)


def one_line(text: Column) -> Column:
    """Newlines replaced by spaces."""
    return F.replace(text, F.lit("\n"), F.lit(" "))


def one_line_rows(df: DataFrame) -> DataFrame:
    """``df`` with newlines replaced in all text columns."""
    return df.withColumns({c: one_line(F.col(c)) for c, kind in df.dtypes if kind == "string"})


def reorder_dump(df: DataFrame) -> DataFrame:
    """A dump's columns in normalised order."""
    return df.select("comment_id", "article_id", "author_id", "comment_text", "timestamp", "parent_comment_id", "upvotes")


def drop_header_rows(df: DataFrame) -> DataFrame:
    """Without rows that repeat the header (told by the id column), wherever they stand."""
    return df.where(~F.col("comment_id").eqNullSafe("comment_id"))


def repaired_fields(line: Column) -> Column:
    """Fields of a quoted CSV line whose inner quotes were not doubled."""
    return F.split(F.substr(line, F.lit(2), F.greatest(F.length(line) - 2, F.lit(0))), '","', -1)


def field_counts(df: DataFrame, fields: Column, least: int = 8, most: int = 8) -> DataFrame:
    """(bad, total): rows whose number of fields isn't between ``least`` and ``most``."""
    return df.agg(F.count_if(~F.size(fields).between(least, most)).alias("bad"), F.count("*").alias("total"))
