from termloom import storage
from termloom.operators import index as ix
from termloom.plans import planner as pl
from termloom.plans.planner import Planner
from termloom.plans.query import parse

QUERIES = ["blue", "blue green", "'blue gre'", "'blue gre'*", "green AND blue", "blue NOT 'green red'", "gr*", "nothing", "'nothing here'", "red OR 'reen re'", "'blue green red'", "ReplyTo:3", "'green'*"]


def test_a_batch_reads_postings_and_texts_once(spark, tmp_path, monkeypatch):
    words = ["blue", "green", "red", "grey", "x"]
    texts = [(i, i + 1000, " ".join(words[(i * k + k // 2) % 5] for k in range(1, 2 + i % 9))) for i in range(200)]
    comments = spark.createDataFrame(texts, "locator long, cid long, text string")
    index = ix.build(comments, str(tmp_path))
    for named in (1000, 5):  # phrases of rare terms, of frequent ones
        monkeypatch.setattr(pl, "NAMED", named)
        single = {}
        for i, q in enumerate(QUERIES):
            rows = Planner(index).search(q, 7).collect()
            if parse(q).boolean:  # all rows, by locator
                rows = rows[::-1][:7]
            single[i] = [(r["cid"], r["locator"], r.asDict().get("score", 0.0)) for r in rows]
        kept = []
        monkeypatch.setattr(storage, "stored", lambda df, real=storage.stored: kept.append(real(df)) or kept[-1])
        found = Planner(index).search_batch(list(enumerate(QUERIES)), 7)
        got = {i: [] for i in range(len(QUERIES))}
        for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
            got[r["query_id"]].append((r["cid"], r["locator"], r["score"]))
        assert got == single
        assert len(kept) == (1 if named == 1000 else 2)
        files = found.inputFiles()
        assert not any("/postings/" in f for f in files) and len([f for f in files if "/comments/" in f]) <= len(index.comments.inputFiles())
        monkeypatch.undo()
