"""Command line: build an index, or answer a file of queries.

    python -m termloom.cli index COMMENTS.csv INDEX [--english]
    python -m termloom.cli search INDEX QUERIES.txt [--topN N] [--printIdsOnly] [--english]
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from termloom.functions.analysis import ENGLISH, PLAIN
from termloom.operators import index as ix
from termloom.plans.planner import Planner
from termloom.plans.query import QueryError
from termloom.session import session
from termloom.sources.comments import read_comments, read_queries
from termloom.timing import Timer


def printed(planner: Planner, query: str, top_n: int | None, ids_only: bool) -> list[str]:
    found = planner.search(query, top_n)
    if ids_only:
        return [",".join(str(r["cid"]) for r in found.select("cid").collect())]
    return [f"{r['cid']},{r['text']}" for r in planner.texts(found).orderBy(*([F.desc("score"), F.desc("locator")] if "score" in found.columns else ["locator"])).collect()]


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="termloom")
    sub = parser.add_subparsers(dest="what", required=True)
    make = sub.add_parser("index")
    make.add_argument("comments")
    make.add_argument("index")
    ask = sub.add_parser("search")
    ask.add_argument("index")
    ask.add_argument("queries")
    ask.add_argument("--topN", type=int)
    ask.add_argument("--printIdsOnly", action="store_true")
    for p in (make, ask):
        p.add_argument("--english", action="store_true")
    a = parser.parse_args(args)
    spark, timer = session(), Timer()
    analyzer = ENGLISH if a.english else PLAIN
    if a.what == "index":
        with timer.phase("building the index"):
            comments = read_comments(spark, a.comments).withColumn("locator", F.col("cid"))
            ix.build(comments, a.index, analyzer)
    else:
        planner = Planner(ix.load(spark, a.index, analyzer, with_replies=True))
        for row in read_queries(spark, a.queries).orderBy("query_id").toLocalIterator():
            with timer.phase("searching"):
                try:
                    print(*printed(planner, row["query"], a.topN, a.printIdsOnly), sep="\n")
                except QueryError as e:
                    print(f"{row['query']}: {e}", file=sys.stderr)
    for name, seconds, share in timer.report():
        print(f"{name}: {seconds:.2f} s, {share:.0f} %", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
