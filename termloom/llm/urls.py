"""URL filter: a trie over reversed host labels and path segments.

A rule is a host and a path prefix. Its host's labels, last first, lead to a trie
node; below it the path's full segments lead on, and a last partial segment is
kept at the node as a prefix. A url walks down its own host labels and, from every
node with path rules, its segments. Of the rules met the longest wins (host and
path together); of equally long ones a block.

The trie is broadcast. It grows with the rule list, not with the data, and a list
of more than ``max_rules`` rules is refused.

Defined cases: a null url or one without ``://`` has empty host and path and meets
no rule; a url that meets no rule gets ``default``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm import common

# Fixed values: (verdict, host, path) of the rules of the page query.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


class Trie:
    def __init__(self, rules: Iterable[tuple[str, str, str]], max_rules: int = 1_000_000):
        self.root: dict = {}
        for n, (verdict, host, path) in enumerate(rules):
            if n >= max_rules:
                raise ValueError(f"over {max_rules} rules")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            *full, rest = path.split("/")
            for segment in full:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            rank = (len(host) + len(path), verdict == "block")
            ends = node.setdefault("ends", {})
            ends[rest] = max(ends.get(rest, ((-1, False),)), (rank, host + path, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the longest rule that fits."""
        best = ((-1, False), None, None)
        segments = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            below, depth = node, 0
            while below is not None:
                for rest, rule in below.get("ends", {}).items():
                    if "/".join(segments[depth:]).startswith(rest) and depth < len(segments) and rule > best:
                        best = rule
                # a full segment must be followed by a slash in the url
                below = below.get("segments", {}).get(segments[depth]) if depth < len(segments) - 1 else None
                depth += 1
        return best[1], best[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host after the first ``://``, and the path up to ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(common.lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, *, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each page's url."""
    import pyarrow as pa

    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))

    def judged(batches: Iterator) -> Iterator:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            met = [trie.value.match(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pa.record_batch([*batch.columns, pa.array([r for r, _ in met], pa.string()), pa.array([v or default for _, v in met], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string")
