"""Explicit schemas of the corpus tables and of the index tables."""

from __future__ import annotations

COMMENTS = "cid long, article_id int, author_id int, text string, ts string, parent_cid long, upvotes int, downvotes int"
ARTICLES = "article_id int, url string"
AUTHORS = "author_id int, name string"
#: What a crawl writes, now and earlier (with one vote count).
CRAWLED = "cid long, url string, author string, ts string, parent string, upvotes int, downvotes int, text string"
CRAWLED_OLD = "cid long, url string, author string, ts string, parent string, upvotes int, text string"
#: A newspaper dump; its header may turn up anywhere, so all is read as text.
DUMP = "article_id string, author_id string, comment_id string, comment_text string, parent_comment_id string, timestamp string, upvotes string"

POSTINGS = "term string, locator long, doc_len int, tf int, positions array<int>, bits long"
LEXICON = "term string, df long, cf long, posting_bytes long"
DOC_STATS = "locator long, doc_len int"
CORPUS_STATS = "c long, n_docs long"
REPLIES = "parent_cid long, child_cid long, child_locator long"
