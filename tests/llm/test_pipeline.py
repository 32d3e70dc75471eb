import corpus_pipeline
from conftest import SF
from termloom.llm import common
from test_operators import brute_hits, brute_representatives, checked_packing


def test_stages_one_by_one(spark):
    docs = common.stored(common.table(spark, SF, "documents"))
    bench = [(r["item_id"], r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.stored(stage(spark, docs, SF))
        assert kept.columns == docs.columns
        before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, kept))
        assert set(after) <= set(before) and len(after) > 0.5 * len(before)
        if name == "near_duplicates":
            assert sorted(after) == sorted(brute_representatives(list(before.items())))
        if name == "decontamination":
            assert set(after) == {h[0] for h in brute_hits(list(before.items()), bench) if h[3] == 0}
        docs = kept
    checked_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_empty(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, SF)
        assert docs_out.count() == 0


def test_stages_on_edge_documents(spark):
    from test_operators import edge_documents

    docs, rows = edge_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF))
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    # no letters: 0, 1, 2, 8; copies of 6: 7, and 6 itself, which stands twice
    assert sorted(str(i) for i, _ in left) == sorted(["3", "4", "5", "6", "9", "None"])
    checked_packing(corpus_pipeline.STAGES[-1][1](spark, docs, SF), left)
