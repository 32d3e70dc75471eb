"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import ann, chat, decontam, langid, licenses, neardup, packing, quality, toxicity, urls
from termloom.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "\\### Assistant: </turn> ok"
    # range() and not a Python list, so that the plan holds no Python data
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    events = rows.select("conv_id", F.col("turn").alias("seq"), "turn", "role", F.lit("message").alias("op"), "text")
    return chat.digests(chat.format_log(events))


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), cached=800_000)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_nearest_vectors, op2_chat_format, op3_pack, op4_quality, op5_language, op6_toxicity, op7_url_filter, op8_decontaminate, op9_near_duplicates, op10_license_scan)}

_OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
said AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS masked,
    sum(14 + length(role) + length(text)
      + 2 * length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '>', '')) - length(role || text)) AS chars
  FROM rows GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(masked) AS BIGINT) AS loss_chars,
  sha256(masked) AS loss_sha256, CAST(chars + n_turns AS BIGINT) AS formatted_chars
FROM said
"""

_OP7 = """
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM a),
rules(v, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
met AS (SELECT b.page_id, h || p AS rule, v, row_number() OVER (PARTITION BY b.page_id ORDER BY length(h || p) DESC, v DESC) AS n
  FROM b JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT CAST(b.page_id AS BIGINT) AS page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM b LEFT JOIN met ON met.page_id = b.page_id AND n = 1
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, w[s:s + k - 1] AS g FROM (SELECT item_id, w, least(8, len(w)) AS k, unnest(generate_series(1, len(w) - least(8, len(w)) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, s, w[s:s + k - 1] AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, s, dw.k FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_TEMPLATES = ", ".join("('{}', '{}', {}, {}, {}, '{}', '{}')".format(*row) for row in licenses.places())

_OP10 = f"""
WITH template(phrase, label, is_base, n, t, w1, w2) AS (VALUES {_TEMPLATES}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, p, w[p + 1] AS w1, w[p + 2] AS w2 FROM (SELECT r, w, unnest(generate_series(0, len(w) - 2)) AS p FROM d WHERE len(w) >= 2)),
voted AS (SELECT r, phrase, label, is_base, n, p - t AS diagonal, t FROM g JOIN template USING (w1, w2)),
banded AS (SELECT r, phrase, label, is_base, n, t, unnest(generate_series(diagonal - CASE WHEN is_base THEN 0 ELSE {licenses.DRIFT} + n // 8 END, diagonal)) AS band FROM voted),
found AS (SELECT r, label, is_base, band, count(DISTINCT t) / n AS cover FROM banded GROUP BY r, phrase, label, is_base, n, band HAVING count(DISTINCT t) / n >= CASE WHEN is_base THEN 1.0 ELSE {licenses.COVER} END)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(*) FILTER (is_base) AS n_base,
  CAST(min(band) FILTER (is_base) AS BIGINT) AS first_word, CAST(max(band) FILTER (is_base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(cover), 0.0) AS score
FROM d LEFT JOIN found USING (r) GROUP BY r, doc_id
"""

_OP9 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT r, w[i:i + 4] AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
link AS (SELECT x, y FROM shared JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE c >= 0.8 * (p.n + q.n - c)
  UNION SELECT a.r, b.r FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.r <> b.r WHERE len(a.w) > 0 AND len(b.w) > 0),
reached(r, z) AS (SELECT r, r FROM d UNION SELECT reached.r, link.y FROM reached JOIN link ON link.x = reached.z)
SELECT CAST(any_value(d.doc_id) AS BIGINT) AS doc_id, CAST(min(e.doc_id) AS BIGINT) AS class_id FROM reached JOIN d ON d.r = reached.r JOIN d e ON e.r = reached.z GROUP BY reached.r
"""

_OP1 = """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM p)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(k AS INTEGER) AS rank, CAST(vec_id AS BIGINT) AS vec_id, score FROM o WHERE k <= 20
"""

ORACLE_SQL = {"op1_nearest_vectors": _OP1, "op2_chat_format": _OP2, "op7_url_filter": _OP7, "op8_decontaminate": _OP8, "op9_near_duplicates": _OP9, "op10_license_scan": _OP10}
