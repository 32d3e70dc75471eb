"""Comment threads from a paged web service.

A page is a JSON object: ``response`` is a list of posts, ``cursor`` has ``hasNext`` and
``next``. Threads are spread over tasks; one task follows the cursors of one thread.
The endpoint is a template with ``{thread}`` and ``{cursor}``; keys and hosts belong to
the caller.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.sources.comments import first_of_each

FIRST_CURSOR = "0:0:0"
POSTS = "cid long, url string, author string, ts string, parent string, upvotes int, downvotes int, text string, seq long"


def posts_of(thread: str, endpoint: str, *, pause: float = 0.01, timeout: float = 60) -> Iterator[dict]:
    """The posts of a thread, page after page."""
    cursor = FIRST_CURSOR
    while True:
        with urlopen(endpoint.format(thread=quote(thread), cursor=quote(cursor)), timeout=timeout) as page:
            data = json.load(page)
        yield from data["response"]
        if not data["cursor"]["hasNext"]:
            return
        cursor = data["cursor"]["next"]
        time.sleep(pause)


def fetch(threads: DataFrame, endpoint: str, *, pause: float = 0.01) -> DataFrame:
    """(cid, url, author, text, ts, parent_cid, upvotes, downvotes) of threads (url, thread_id); of a post seen twice the first."""
    import pyarrow as pa

    names = [f.split()[0] for f in POSTS.split(", ")]

    def fetched(batches: Iterator) -> Iterator:
        for batch in batches:
            for url, thread in zip(batch.column("url").to_pylist(), batch.column("thread_id").to_pylist(), strict=True):
                rows = [(int(p["id"]), url, p["author"]["name"], str(p["createdAt"]), None if p["parent"] is None else str(p["parent"]), p["likes"], p["dislikes"], p["raw_message"], n) for n, p in enumerate(posts_of(thread, endpoint, pause=pause))]
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int64())
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    posts = threads.where(F.col("thread_id").isNotNull()).select("url", F.col("thread_id").cast("string").alias("thread_id")).mapInArrow(fetched, POSTS)
    once = first_of_each(posts, "cid", "seq")
    return once.select("cid", "url", "author", "text", "ts", F.col("parent").try_cast("long").alias("parent_cid"), "upvotes", "downvotes")
