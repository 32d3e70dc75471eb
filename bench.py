"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The index build is timed on its own; each search is timed over the materialised
index, as the median of three runs after one that warms up.
"""

from __future__ import annotations

import json
import os
import statistics
import time


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from termloom.plans import catalog
    from termloom.session import session

    spark = session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="12g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, run, times: int) -> None:  # noqa: ANN001
        taken = []
        for _ in range(times):
            began = time.perf_counter()
            run()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken[1:] or taken), 4)

    sink = lambda f: lambda: f(spark, sf_dir).write.format("noop").mode("overwrite").save()
    timed("index_build", lambda: catalog.index_of(spark, sf_dir), 1)
    for name in ("ranked_keywords", "keyword", "prefix", "phrase", "phrase_prefix", "bool_mixed", "topk_ties", "batch_search", "stop_terms"):
        timed(name, sink(catalog.QUERIES[name]), 4)
    for name in ("dedup_first", "page_links", "char_freq", "vector_nn"):
        timed(name, sink(catalog.QUERIES[name]), 2)
    try:
        from termloom.llm.queries import QUERIES as more
    except ImportError:
        more = {}
    for name, f in more.items():
        timed(name, sink(f), 1)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus)}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
