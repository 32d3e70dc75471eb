import math

import pytest
from pyspark.sql import functions as F

from termloom.functions.analysis import ENGLISH, PLAIN
from termloom.operators import index as ix
from termloom.plans.planner import Planner


@pytest.mark.parametrize("analyzer", [PLAIN, ENGLISH], ids=lambda a: a.name)
def test_ranked_search_over_terms_of_several_ranges(spark, tmp_path, monkeypatch, analyzer):
    monkeypatch.setattr(ix, "TOKENS_A_RANGE", 60)
    words = ["blue", "green", "red", "grey", "runner", "x"]
    texts = {i: " ".join(words[(i * k + k // 2) % 6] for k in range(1, 2 + i % 9)) for i in range(150)}
    comments = spark.createDataFrame([(i, i, t) for i, t in texts.items()], "locator long, cid long, text string")
    index = ix.build(comments, str(tmp_path), analyzer)
    files = index.postings.select("term", F.input_file_name()).distinct().groupBy("term").agg(F.count("*").alias("n"))
    assert files.agg(F.max("n")).first()[0] > 1
    planner = Planner(index, stop_share=1e9)
    got = [(r["locator"], r["score"]) for r in planner.search("blue runner", 20).collect()]
    c = sum(len(t.split()) for t in texts.values())
    score = {}
    for i, t in texts.items():
        tokens = t.split()
        if "blue" in tokens or "runner" in tokens:
            score[i] = round(sum(math.log((tokens.count(w) + 1500 * sum(u.split().count(w) for u in texts.values()) / c) / (len(tokens) + 1500)) for w in ("blue", "runner")), 6)
    want = sorted(score.items(), key=lambda x: (-x[1], -x[0]))[:20]
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)
