"""Readers and writers of comment corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import schema
from termloom.storage import stored

#: Doubled quotes, records over several lines, blank lines inside quotes.
CSV = {"quote": '"', "escape": '"', "multiLine": "true", "encoding": "UTF-8"}


def _csv(spark: SparkSession, path: str, columns: str, header: bool) -> DataFrame:
    return spark.read.schema(columns).options(**CSV).option("header", header).csv(path)


def parent_id(text: Column) -> Column:
    """A parent id; empty text and the word None mean no parent."""
    return F.when(F.trim(text).isin("", "None"), F.lit(None)).otherwise(text).try_cast("long")


def _voted(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("upvotes", "downvotes")})


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    """Normalised comments, 6 to 8 columns, no header; absent votes are 0.

    Files with records over several lines can't be split: one task reads one file.
    """
    raw = schema.COMMENTS.replace("parent_cid long", "parent string")
    return _voted(_csv(spark, path, raw, False).withColumn("parent_cid", parent_id(F.col("parent")))).select(*(f.split()[0] for f in schema.COMMENTS.split(", ")))


def read_crawled(spark: SparkSession, path: str, *, header: bool = True, old: bool = False) -> DataFrame:
    """A crawl's output: (cid, url, author, text, ts, parent_cid, upvotes, downvotes)."""
    df = _csv(spark, path, schema.CRAWLED_OLD if old else schema.CRAWLED, header)
    if old:
        df = df.withColumn("downvotes", F.lit(0))
    return _voted(df.withColumn("parent_cid", parent_id(F.col("parent")))).select("cid", "url", "author", "text", "ts", "parent_cid", "upvotes", "downvotes")


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """A newspaper dump in normalised column order; header rows, wherever they stand, are left out."""
    from termloom.functions.cleaning import drop_header_rows, reorder_dump

    return reorder_dump(drop_header_rows(_csv(spark, path, schema.DUMP, False)))


def read_id_list(spark: SparkSession, path: str, id_name: str = "id", value_name: str = "value") -> DataFrame:
    """(id, value) of lines ``id,value``; only the first comma separates."""
    parts = F.split(F.col("value"), ",", 2)
    return spark.read.text(path).select(F.get(parts, F.lit(0)).try_cast("int").alias(id_name), F.get(parts, F.lit(1)).alias(value_name))


def id_list_gaps(ids: DataFrame, id_name: str = "id") -> DataFrame:
    """Whether ids are dense: (n, lowest, highest, n_distinct); n_distinct = highest - lowest + 1 = n if so."""
    return ids.agg(F.count("*").alias("n"), F.min(id_name).alias("lowest"), F.max(id_name).alias("highest"), F.count_distinct(id_name).alias("n_distinct"))


def normalise(crawled: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(comments, articles, authors): crawl output with urls and authors replaced by dense ids."""
    articles = dense_ids(crawled.select("url"), "url", "article_id")
    authors = dense_ids(crawled.select(F.col("author").alias("name")), "name", "author_id")
    comments = crawled.join(articles, "url").join(authors, crawled["author"] == authors["name"])
    return comments.select("cid", "article_id", "author_id", "text", "ts", "parent_cid", "upvotes", "downvotes"), articles, authors


def dense_ids(df: DataFrame, column: str, id_name: str) -> DataFrame:
    """Distinct values with ids from 0 in their order.

    Values are range-partitioned and counted by partition, so that no task holds
    all of them.
    """
    from pyspark.sql import Window

    # stored, as both uses must see the same partitions
    values = stored(df.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).select(column, F.spark_partition_id().alias("part")))
    inside = values.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy(column)))
    sizes = values.groupBy("part").agg(F.count("*").alias("size"))
    bases = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return inside.join(F.broadcast(bases), "part").select((F.col("base") + F.col("n") - 1).cast("int").alias(id_name), column)


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; keys seen again are left out."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_first")).select(key, *(F.col(f"_first.{c}").alias(c) for c in columns))


def conflicting_ids(comments: DataFrame, key: str = "cid") -> DataFrame:
    """Ids that stand for different contents: (id, n_versions)."""
    rest = F.xxhash64(*(c for c in comments.columns if c != key))
    return comments.groupBy(key).agg(F.count_distinct(rest).alias("n_versions")).where("n_versions > 1")


def write_crawled(df: DataFrame, path: str) -> None:
    """Crawl output: all fields quoted, quotes doubled, with a header."""
    df.write.option("quoteAll", True).option("escape", '"').option("header", True).csv(path)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query) of a file of one query a line; blank lines are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("query_id", "query"))
    return lines.select(F.col("query_id").cast("long").alias("query_id"), F.trim("query").alias("query")).where("query <> ''")


def read_lenient_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file; bytes that aren't UTF-8 are left out."""
    return spark.read.text(path).select(F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit("")).alias("value"))


def read_lines(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(text): one document a line, in an encoding whose line ends are those of ASCII."""
    return spark.read.text(path).select(F.decode(F.col("value").cast("binary"), encoding).alias("text"))


def training_texts(spark: SparkSession, path: str, limit: int = 50_000_000) -> DataFrame:
    """(text): the fourth column of a CSV file with header, up to ``limit`` rows, as vector training takes it."""
    columns = spark.read.options(**CSV).option("header", True).csv(path)
    return columns.select(F.col(f"`{columns.columns[3]}`").alias("text")).limit(limit)


def seed_urls(spark: SparkSession, prefix: str = "", suffix: str = ".html") -> DataFrame:
    """(url): one archive page a day, 2015 and 2016, months 1 to 11, days 1 to 30, as yyyymmdd."""
    year = spark.range(1).select(F.explode(F.sequence(F.lit(2015), F.lit(2016))).alias("y"))
    days = year.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(11)))).withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(30))))
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    return days.select(F.concat(F.lit(prefix), F.col("y").cast("string"), two("m"), two("d"), F.lit(suffix)).alias("url"))
