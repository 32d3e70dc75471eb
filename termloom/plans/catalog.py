"""The registered queries of the library over the test tables, and their SQL.

Each query runs over its whole tables. Search queries share one index for each data
folder and session, which is built at first use and kept in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom import storage
from termloom.functions import cleaning
from termloom.functions.analysis import ENGLISH, PLAIN, Analyzer, vector_tokens
from termloom.operators import index as ix
from termloom.operators import pages as pg
from termloom.operators import ranking, vectors
from termloom.plans.planner import STOP_SHARE, Planner
from termloom.sources import comments as src
from termloom.sources.tables import comments, table, thread_comments

_indexes: dict[tuple, ix.Index] = {}


def index_of(spark: SparkSession, sf_dir: str, analyzer: Analyzer = PLAIN, source: Callable = comments) -> ix.Index:
    """The index of a data folder; built once for a session."""
    key = (spark.sparkContext.applicationId, sf_dir, analyzer.name, source.__name__)
    if key not in _indexes:
        _indexes[key] = ix.build(source(spark, sf_dir), f"{storage.checkpoint_root(spark)}/index/{uuid.uuid4().hex}", analyzer)
    return _indexes[key]


def _searched(query: str, top_k: int | None = None, *, analyzer: Analyzer = PLAIN, source: Callable = comments) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Planner(index_of(spark, sf_dir, analyzer, source)).search(query, top_k)

    return run


# DuckDB: the plain analyzer and the index, from documents.
_TOKENS = r"""
tok AS (SELECT doc_id AS locator, w, len(w) AS doc_len FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents)),
each AS (SELECT locator, doc_len, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM tok),
post AS (SELECT term, locator, doc_len, count(*) AS tf, list(pos ORDER BY pos) AS positions FROM each WHERE length(term) BETWEEN 2 AND 126 GROUP BY ALL),
corpus AS (SELECT sum(doc_len) AS c, count(*) AS n_docs FROM tok),
lines AS (SELECT term, count(*) AS df, sum(tf) AS cf, CAST(sum(tf) AS VARCHAR) || string_agg(chr(7) || locator || ',' || array_to_string(positions, ','), '' ORDER BY locator) AS line FROM post GROUP BY term),
lex AS (SELECT term, CAST(df AS BIGINT) AS df, CAST(cf AS BIGINT) AS cf,
  CAST(floor((4 * length(line) - (length(line) - length(translate(line, '123,', '')))) / 8) + 1 AS BIGINT) AS posting_bytes FROM lines)
"""


def _ranked_sql(words: list[str], candidates: str, k: int | None) -> str:
    terms = ", ".join(f"({i}, '{w}')" for i, w in enumerate(words))
    limit = f"ORDER BY score DESC, locator DESC LIMIT {k}" if k else ""
    return f"""WITH {_TOKENS},
cand AS ({candidates}),
q(i, term) AS (VALUES {terms}),
s AS (SELECT q.i, lex.term, lex.cf FROM q JOIN lex USING (term), corpus WHERE posting_bytes <= c / 100.0),
scored AS (SELECT cand.locator, round(coalesce(sum(ln((coalesce(post.tf, 0) + 1500.0 * s.cf / c) / (tok.doc_len + 1500.0))), 0.0), 6) AS score
  FROM cand JOIN tok USING (locator) CROSS JOIN corpus LEFT JOIN s ON true LEFT JOIN post ON post.term = s.term AND post.locator = cand.locator GROUP BY cand.locator)
SELECT locator AS cid, locator, CAST(score AS DOUBLE) AS score FROM scored {limit}"""


def _docs_with(*terms: str) -> str:
    return f"SELECT DISTINCT locator FROM post WHERE term IN ({', '.join(repr(t) for t in terms)})"


def _boolean_sql(candidates: str) -> str:
    return f"WITH {_TOKENS} SELECT locator AS cid, locator FROM ({candidates})"


def _phrase_candidates(words: list[str], phrase: str) -> str:
    """The documents of the phrase's rarest word, and of the second if it is no stop term, that hold the phrase."""
    listed = ", ".join(repr(w) for w in words)
    return f"""SELECT locator FROM (SELECT locator, count(*) AS n FROM post WHERE term IN (
      SELECT term FROM (SELECT term, posting_bytes, row_number() OVER (ORDER BY posting_bytes, term) AS r FROM lex WHERE term IN ({listed})), corpus WHERE r = 1 OR r = 2 AND posting_bytes < c / 100.0)
      GROUP BY locator) WHERE n = (SELECT count(*) FROM (SELECT posting_bytes, row_number() OVER (ORDER BY posting_bytes, term) AS r FROM lex WHERE term IN ({listed})), corpus WHERE r = 1 OR r = 2 AND posting_bytes < c / 100.0)
      AND locator IN (SELECT doc_id FROM documents WHERE contains(lower(text), '{phrase}'))"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as comma-joined text, which compares alike in both engines."""
    p = index_of(spark, sf_dir).postings
    return p.select("term", "locator", F.col("doc_len").cast("long").alias("doc_len"), F.col("tf").cast("long").alias("tf"), F.array_join("positions", ",").alias("positions"))


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).lexicon.select("term", "df", "cf", "posting_bytes")


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).doc_stats.select("locator", F.col("doc_len").cast("long").alias("doc_len"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.corpus_stats_of(index_of(spark, sf_dir).doc_stats)


def posting_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).lexicon.select("term", "posting_bytes")


def stop_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    return index.lexicon.where(F.col("posting_bytes") > index.c * STOP_SHARE).select("term", "posting_bytes")


def dim_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = comments(spark, sf_dir)
    dims = src.dense_ids(docs, "source", "source_id")
    return docs.join(dims, "source").select("cid", F.col("source_id").cast("long").alias("source_id"), "source")


def reply_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.reply_index(thread_comments(spark, sf_dir)).select("parent_cid", F.array_join("children", ",").alias("children"))


def cid_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.cid_index(comments(spark, sf_dir))


def load_by_cid(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(0, 50, 7).select((F.col("id") * 3).alias("cid"))
    return ix.by_cid(comments(spark, sf_dir), wanted).select("cid", "locator", F.length("text").cast("long").alias("n_chars"))


def char_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ix.char_frequencies(table(spark, sf_dir, "documents"), "text")


def fullwidth_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the texts' commas and stops are made fullwidth first, as the test tables hold none."""
    wide = F.replace(F.replace(F.col("text"), F.lit(", "), F.lit("，")), F.lit(". "), F.lit("。"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cleaning.ascii_punctuation(wide).cast("binary")).alias("digest"))


def newline_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.one_line_rows(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def column_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dump = docs.select(F.col("source").alias("article_id"), F.col("lang").alias("author_id"), F.col("doc_id").cast("string").alias("comment_id"), F.md5(F.col("text").cast("binary")).alias("comment_text"), F.lit("").alias("parent_comment_id"), F.lit("2016-01-01").alias("timestamp"), F.col("n_chars").cast("string").alias("upvotes"))
    header = spark.range(1).select(*(F.lit(c).alias(c) for c in dump.columns))
    return cleaning.reorder_dump(cleaning.drop_header_rows(dump.unionByName(header)))


def field_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.field_counts(table(spark, sf_dir, "documents"), F.split("text", ",", -1))


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("post_id"), F.col("doc_id").alias("seq"), "source")
    return src.first_of_each(docs, "post_id", "seq")


def conflicting_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("cid"), "role", "text")
    return src.conflicting_ids(turns)


def seed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.seed_urls(spark)


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.links(table(spark, sf_dir, "pages"))


def page_links_of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.links(table(spark, sf_dir, "pages"), "example.com")


def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", pg.without_query(F.col("url")).alias("url"))


def thread_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second page gets a thread mark first, as the test pages hold none."""
    html = F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit("<script>var disqus_identifier = '"), F.col("page_id").cast("string"), F.lit("';</script>"))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", pg.thread_id(html).alias("thread_id"))


def vector_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_to(table(spark, sf_dir, "embeddings"), k=5)


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourteen kinds of a query file, in one job."""
    found = Planner(index_of(spark, sf_dir)).search_batch([(i, q) for i, (q, _) in enumerate(BATCH)], 10)
    return found.withColumn("rank", F.col("rank").cast("long"))


def english_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Planner(index_of(spark, sf_dir, ENGLISH)).search("ntea oure", 10)


def english_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir, ENGLISH).lexicon


def crawl_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pg.crawl(pages, pages.select("url"), "example.com", 1)


def crawl_depth_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the first page on, as deep as a crawl goes by default."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return pg.crawl(pages, pages.orderBy("page_id").limit(1).select("url"), "example.com")


def _file(spark: SparkSession) -> str:
    """A new path for a file that a query writes first, as the test tables are Parquet only."""
    return f"{storage.checkpoint_root(spark)}/files/{uuid.uuid4().hex}"


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a crawl's output: texts of several lines, quotes and commas; every third has a parent."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit('say "so",\n'), F.coalesce("text", F.lit("")), F.lit('\n\n"'))
    parent = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") + 1).cast("string")).otherwise("None")
    cells = {"cid": F.col("doc_id"), "url": F.concat(F.lit("https://"), "source", F.lit("/a")), "author": F.col("lang"), "ts": F.lit("2016-01-01"), "parent": parent, "upvotes": F.col("n_chars").cast("int"), "downvotes": F.lit(None).cast("int"), "text": text}
    return docs.select(*(c.alias(name) for name, c in cells.items()))


def crawled_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl's output written as CSV and read again."""
    path = _file(spark)
    src.write_crawled(_crawled(spark, sf_dir), path)
    return src.read_crawled(spark, path).select("cid", "url", "author", "ts", "parent_cid", F.col("upvotes").cast("long").alias("upvotes"), F.col("downvotes").cast("long").alias("downvotes"), F.md5(F.col("text").cast("binary")).alias("digest"))


def normalised_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl output with dense ids for urls and authors, written as a comment file without header and read again."""
    path = _file(spark)
    src.write_crawled(_crawled(spark, sf_dir), path)
    comments_, _, _ = src.normalise(src.read_crawled(spark, path))
    normal = _file(spark)
    comments_.write.option("quoteAll", True).option("escape", '"').csv(normal)
    read = src.read_comments(spark, normal)
    return read.select("cid", F.col("article_id").cast("long").alias("article_id"), F.col("author_id").cast("long").alias("author_id"), "parent_cid", F.col("upvotes").cast("long").alias("upvotes"), F.md5(F.col("text").cast("binary")).alias("digest"))


def id_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _file(spark)
    table(spark, sf_dir, "documents").select(F.concat_ws(",", "doc_id", "source", "lang")).write.text(path)
    return src.read_id_list(spark, path).select(F.col("id").cast("long").alias("id"), "value")


def id_list_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether page ids are dense, and one id beyond a gap."""
    path = _file(spark)
    lines = table(spark, sf_dir, "pages").select(F.concat_ws(",", "page_id", "url").alias("line")).unionByName(spark.range(1).select(F.lit("1000000000,far").alias("line")))
    lines.write.text(path)
    return src.id_list_gaps(src.read_id_list(spark, path)).select(*(F.col(c).cast("long").alias(c) for c in ("n", "lowest", "highest", "n_distinct")))


def query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country names as a file of queries, with blank lines between."""
    path = _file(spark)
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("  "), "n_name", F.lit(" \n")).alias("line"), "n_nationkey")
    names.coalesce(1).sortWithinPartitions("n_nationkey").select("line").write.text(path)
    return src.read_queries(spark, path)


def repaired_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of quoted lines whose inner quotes were not doubled."""
    line = F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('","say "so" '), F.coalesce("text", F.lit("")), F.lit('","'), F.coalesce("lang", F.lit("")), F.lit('"'))
    fields = cleaning.repaired_fields(line)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(fields).cast("long").alias("n_fields"), F.md5(F.array_join(fields, "|").cast("binary")).alias("digest"))


def vector_tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = vector_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(tokens, " ").cast("binary")).alias("digest"))


def random_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments at the locators of a list, one of them unknown, one named twice."""
    wanted = spark.range(0, 60, 4).select((F.col("id") * F.col("id") - 16).alias("locator")).unionByName(spark.range(1).select(F.lit(0).cast("long").alias("locator")))
    return ix.random_access(comments(spark, sf_dir), wanted).select("cid", "locator", F.md5(F.col("text").cast("binary")).alias("digest"))


def training_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts for vector training, the fourth column of a file with header."""
    path = _file(spark)
    src.write_crawled(_crawled(spark, sf_dir).select("cid", "url", "author", "text", "ts"), path)
    return src.training_texts(spark, path).select(F.md5(F.col("text").cast("binary")).alias("digest"))


_RESOLVED = r"""SELECT page_id, CASE WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN raw
  WHEN starts_with(raw, '//') THEN regexp_extract(url, '^([^:]*:)', 1) || raw
  WHEN starts_with(raw, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || raw
  ELSE regexp_extract(url, '^([^?#]*/)', 1) || raw END AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw FROM pages)"""

_REPLY_CHILDREN = "SELECT conv_id * 1000 + turn AS locator FROM conversations WHERE turn > 0 AND conv_id * 1000 + turn - 1 = {}"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ranked_keywords": _searched("ntea oure", 10),
    "keyword": _searched("oure AND oure"),
    "prefix": _searched("ntea*"),
    "phrase": _searched("'attion to'"),
    "phrase_prefix": _searched("'eriner thane'*"),
    "bool_and": _searched("ntea AND oure"),
    "bool_or": _searched("ntea OR 'attion to'"),
    "bool_not": _searched("oure NOT ntea"),
    "bool_mixed": _searched("the AND oure NOT ntea OR estion NOT 'attion to' OR ntea*"),
    "reply_to": _searched("ReplyTo:2000", source=thread_comments),
    "reply_to_and_keyword": _searched("ReplyTo:2000 OR ReplyTo:3000 AND the", source=thread_comments),
    "topk_ties": _searched("the", 25),
    "ranked_union": _searched("ntea oure estion ntea", 20),
    "postings": postings,
    "lexicon": lexicon,
    "doc_stats": doc_stats,
    "corpus_stats": corpus_stats,
    "posting_bytes": posting_bytes,
    "stop_terms": stop_terms,
    "dim_decode": dim_decode,
    "reply_index": reply_index,
    "cid_index": cid_index,
    "load_by_cid": load_by_cid,
    "char_freq": char_freq,
    "fullwidth_punct": fullwidth_punct,
    "newline_clean": newline_clean,
    "column_reorder": column_reorder,
    "field_count_check": field_count_check,
    "dedup_first": dedup_first,
    "conflicting_ids": conflicting_ids,
    "seed_urls": seed_urls,
    "page_links": page_links,
    "page_links_of_domain": page_links_of_domain,
    "canonical_url": canonical_url,
    "thread_ids": thread_ids,
    "vector_nn": vector_nn,
    "crawl_links": crawl_links,
    "crawl_depth_4": crawl_depth_4,
    "crawled_csv": crawled_csv,
    "normalised_csv": normalised_csv,
    "id_list": id_list,
    "id_list_gaps": id_list_gaps,
    "query_file": query_file,
    "repaired_csv": repaired_csv,
    "vector_tokens": vector_tokens_of,
    "random_access": random_access,
    "training_texts": training_texts,
    "batch_search": batch_search,
    "english_ranked": english_ranked,
    "english_lexicon": english_lexicon,
}

_PHRASE = _phrase_candidates(["attion", "to"], "attion to")
_PREFIXED = "SELECT DISTINCT locator FROM post WHERE starts_with(term, 'ntea')"

#: The queries of the batch and the SQL of each.
BATCH: list[tuple[str, str]] = [
    ("ntea", _ranked_sql(["ntea"], _docs_with("ntea"), None)),
    ("ntea oure estion", _ranked_sql(["ntea", "oure", "estion"], _docs_with("ntea", "oure", "estion"), None)),
    ("'attion to'", _ranked_sql(["attion", "to"], _PHRASE, None)),
    ("ntea AND oure", _boolean_sql(f"{_docs_with('ntea')} INTERSECT {_docs_with('oure')}")),
    ("the NOT ntea", _boolean_sql(f"{_docs_with('the')} EXCEPT {_docs_with('ntea')}")),
    ("ntea*", _ranked_sql(["ntea"], _PREFIXED, None)),
    ("estion", _ranked_sql(["estion"], _docs_with("estion"), None)),
    ("oure 12", _ranked_sql(["oure", "12"], _docs_with("oure", "12"), None)),
    ("the AND oure AND ntea", _boolean_sql(f"{_docs_with('the')} INTERSECT {_docs_with('oure')} INTERSECT {_docs_with('ntea')}")),
    ("'eriner thanea'", _ranked_sql(["eriner", "thanea"], _phrase_candidates(["eriner", "thanea"], "eriner thanea"), None)),
    ("ntea OR 'attion to'", _boolean_sql(f"{_docs_with('ntea')} UNION {_PHRASE}")),
    ("'eriner thane'*", _ranked_sql(["eriner", "thane"], _phrase_candidates(["eriner"], "eriner thane"), None)),
    ("oure NOT ntea*", _boolean_sql(f"{_docs_with('oure')} EXCEPT {_PREFIXED}")),
    ("ntea AND 'attion to'", _boolean_sql(f"{_docs_with('ntea')} INTERSECT {_PHRASE}")),
]


def _batch_sql() -> str:
    """The ten best of each query of the batch; boolean results score 0."""
    each = [f"SELECT {i} AS query_id, cid, locator, {'score' if 'AS score' in sql else 'CAST(0 AS DOUBLE) AS score'} FROM ({sql})" for i, (_, sql) in enumerate(BATCH)]
    return f"SELECT CAST(query_id AS BIGINT) AS query_id, rank, cid, locator, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, locator DESC) AS rank FROM ({' UNION ALL '.join(each)})) WHERE rank <= 10"


_WIDE = "replace(replace(text, ', ', '，'), '. ', '。')"
for _mark, _to in cleaning.FULLWIDTH.items():
    _WIDE = f"replace({_WIDE}, '{_mark}', '{_to}')"

_IN_DOMAIN = r"regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*\.)?example\.com([/?#]|$)')"
_TEXT = "('say \"so\",' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '\"')"
_PARENT = "CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id + 1 AS BIGINT) END"

ORACLE_SQL: dict[str, str] = {
    "ranked_keywords": _ranked_sql(["ntea", "oure"], _docs_with("ntea", "oure"), 10),
    "keyword": _boolean_sql(_docs_with("oure")),
    "prefix": _ranked_sql(["ntea"], "SELECT DISTINCT locator FROM post WHERE starts_with(term, 'ntea')", None),
    "phrase": _ranked_sql(["attion", "to"], _phrase_candidates(["attion", "to"], "attion to"), None),
    "phrase_prefix": _ranked_sql(["eriner", "thane"], _phrase_candidates(["eriner"], "eriner thane"), None),
    "bool_and": _boolean_sql(f"{_docs_with('ntea')} INTERSECT {_docs_with('oure')}"),
    "bool_or": _boolean_sql(f"{_docs_with('ntea')} UNION {_phrase_candidates(['attion', 'to'], 'attion to')}"),
    "bool_not": _boolean_sql(f"{_docs_with('oure')} EXCEPT {_docs_with('ntea')}"),
    "bool_mixed": _boolean_sql(
        f"(({_docs_with('the')} INTERSECT {_docs_with('oure')}) EXCEPT {_docs_with('ntea')}) UNION ({_docs_with('estion')} EXCEPT {_phrase_candidates(['attion', 'to'], 'attion to')}) UNION SELECT DISTINCT locator FROM post WHERE starts_with(term, 'ntea')"
    ),
    "reply_to": f"SELECT locator AS cid, locator, CAST(0 AS DOUBLE) AS score FROM ({_REPLY_CHILDREN.format(2000)})",
    "reply_to_and_keyword": f"SELECT locator AS cid, locator FROM ({_REPLY_CHILDREN.format(2000)} UNION ({_REPLY_CHILDREN.format(3000)} INTERSECT SELECT conv_id * 1000 + turn FROM conversations WHERE list_contains(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), 'the')))",
    "topk_ties": _ranked_sql(["the"], _docs_with("the"), 25),
    "ranked_union": _ranked_sql(["ntea", "oure", "estion", "ntea"], _docs_with("ntea", "oure", "estion"), 20),
    "postings": f"WITH {_TOKENS} SELECT term, locator, CAST(doc_len AS BIGINT) AS doc_len, CAST(tf AS BIGINT) AS tf, array_to_string(positions, ',') AS positions FROM post",
    "lexicon": f"WITH {_TOKENS} SELECT term, df, cf, posting_bytes FROM lex",
    "doc_stats": f"WITH {_TOKENS} SELECT locator, CAST(doc_len AS BIGINT) AS doc_len FROM tok",
    "corpus_stats": f"WITH {_TOKENS} SELECT CAST(c AS BIGINT) AS c, CAST(n_docs AS BIGINT) AS n_docs FROM corpus",
    "posting_bytes": f"WITH {_TOKENS} SELECT term, posting_bytes FROM lex",
    "stop_terms": f"WITH {_TOKENS} SELECT term, posting_bytes FROM lex, corpus WHERE posting_bytes > c / 100.0",
    "dim_decode": "SELECT doc_id AS cid, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS source_id, source FROM documents",
    "reply_index": "SELECT CAST(conv_id * 1000 + turn - 1 AS BIGINT) AS parent_cid, string_agg(CAST(conv_id * 1000 + turn AS VARCHAR), ',' ORDER BY turn) AS children FROM conversations WHERE turn > 0 GROUP BY 1",
    "cid_index": "SELECT doc_id AS cid, max(doc_id) AS locator FROM documents GROUP BY 1",
    "load_by_cid": "SELECT doc_id AS cid, doc_id AS locator, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE doc_id IN (0, 21, 42, 63, 84, 105, 126, 147)",
    "char_freq": "SELECT ch, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM documents) WHERE ch <> chr(10) GROUP BY ch",
    "fullwidth_punct": f"SELECT doc_id, md5({_WIDE}) AS digest FROM documents",
    "newline_clean": "SELECT doc_id, md5(replace(text, chr(10), ' ')) AS digest FROM documents",
    "column_reorder": "SELECT CAST(doc_id AS VARCHAR) AS comment_id, source AS article_id, lang AS author_id, md5(text) AS comment_text, '2016-01-01' AS timestamp, '' AS parent_comment_id, CAST(n_chars AS VARCHAR) AS upvotes FROM documents",
    "field_count_check": "SELECT CAST(count(*) FILTER (len(string_split(text, ',')) <> 8) AS BIGINT) AS bad, CAST(count(*) AS BIGINT) AS total FROM documents",
    "dedup_first": "SELECT post_id, seq, source FROM (SELECT md5(text) AS post_id, doc_id AS seq, source, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "conflicting_ids": "SELECT conv_id AS cid, CAST(count(DISTINCT (role, text)) AS BIGINT) AS n_versions FROM conversations GROUP BY 1 HAVING count(DISTINCT (role, text)) > 1",
    "seed_urls": "SELECT y || lpad(CAST(m AS VARCHAR), 2, '0') || lpad(CAST(d AS VARCHAR), 2, '0') || '.html' AS url FROM range(2015, 2017) a(y), range(1, 12) b(m), range(1, 31) c(d)",
    "page_links": _RESOLVED,
    "page_links_of_domain": f"SELECT page_id, link FROM ({_RESOLVED}) WHERE regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*\\.)?example\\.com([/?#]|$)')",
    "canonical_url": "SELECT page_id, regexp_replace(url, '\\?.*', '') AS url FROM pages",
    "thread_ids": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) END AS thread_id FROM pages",
    "vector_nn": "WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT e.vec_id, round(1 - list_cosine_similarity(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), q.v), 6) AS distance FROM embeddings e, q WHERE e.vec_id <> q.vec_id ORDER BY distance, e.vec_id LIMIT 5",
    "batch_search": _batch_sql(),
    "crawl_links": f"WITH l AS (SELECT page_id, link FROM ({_RESOLVED}) WHERE regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*\\.)?example\\.com([/?#]|$)')) SELECT url, min(depth) AS depth FROM (SELECT url, 0 AS depth FROM pages UNION ALL SELECT link, 1 FROM l) GROUP BY url",
    "crawl_depth_4": f"""WITH RECURSIVE e AS (SELECT DISTINCT url AS source, link FROM ({_RESOLVED}) JOIN pages USING (page_id) WHERE {_IN_DOMAIN}),
r(url, depth) AS (SELECT * FROM (SELECT url, 0 FROM pages ORDER BY page_id LIMIT 1) UNION SELECT link, depth + 1 FROM r JOIN e ON e.source = r.url WHERE depth < 4)
SELECT url, min(depth) AS depth FROM r GROUP BY url""",
    "crawled_csv": f"SELECT doc_id AS cid, 'https://' || source || '/a' AS url, lang AS author, '2016-01-01' AS ts, {_PARENT} AS parent_cid, CAST(n_chars AS BIGINT) AS upvotes, CAST(0 AS BIGINT) AS downvotes, md5({_TEXT}) AS digest FROM documents",
    "normalised_csv": f"SELECT doc_id AS cid, CAST(dense_rank() OVER (ORDER BY source) - 1 AS BIGINT) AS article_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS BIGINT) AS author_id, {_PARENT} AS parent_cid, CAST(n_chars AS BIGINT) AS upvotes, md5({_TEXT}) AS digest FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL",
    "id_list": "SELECT CAST(doc_id AS BIGINT) AS id, concat_ws(',', source, lang) AS value FROM documents",
    "id_list_gaps": "SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(id) AS BIGINT) AS lowest, CAST(max(id) AS BIGINT) AS highest, CAST(count(DISTINCT id) AS BIGINT) AS n_distinct FROM (SELECT page_id AS id FROM pages UNION ALL SELECT 1000000000)",
    "query_file": "SELECT CAST(2 * (row_number() OVER (ORDER BY n_nationkey) - 1) AS BIGINT) AS query_id, n_name AS query FROM nation",
    "repaired_csv": "SELECT doc_id, CAST(len(string_split(body, '\",\"')) AS BIGINT) AS n_fields, md5(replace(body, '\",\"', '|')) AS digest FROM (SELECT doc_id, doc_id || '\",\"say \"so\" ' || coalesce(text, '') || '\",\"' || coalesce(lang, '') AS body FROM documents)",
    "vector_tokens": r"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nl}\p{No}_]+'), lambda w: length(w) BETWEEN 2 AND 15) AS t FROM documents)",
    "random_access": "SELECT doc_id AS cid, doc_id AS locator, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT i * i - 16 FROM range(0, 60, 4) a(i) UNION SELECT 0)",
    "training_texts": f"SELECT md5({_TEXT}) AS digest FROM documents",
}

assert ranking.MU == 1500.0  # as in the SQL
