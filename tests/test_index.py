import math

import pytest
from pyspark.sql import functions as F

from termloom.functions.analysis import ENGLISH, PLAIN
from termloom.functions.porter2 import stem
from termloom.operators import codec, ranking
from termloom.operators import index as ix
from termloom.plans.planner import Planner

# The layout's prefix code lengths.
SHORT, LONG = "123,", "0456789\a"


def comments(spark, rows, with_parent=False):
    schema = "locator long, cid long, text string" + (", parent_cid long" if with_parent else "")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    rows = [(0, 10, "Tragic event"), (127, 11, "xi > trump"), (255, 12, "some special §¸ … · characters")]
    return ix.build(comments(spark, rows), str(tmp_path_factory.mktemp("golden")), ENGLISH)


def test_golden_index(golden):
    got = {(r["term"], r["locator"]): r["positions"] for r in golden.postings.collect()}
    assert got == {("charact", 255): [5], ("event", 0): [1], ("some", 255): [0], ("special", 255): [1], ("tragic", 0): [0], ("trump", 127): [2], ("xi", 127): [0], ("§¸", 255): [2]}
    assert {r["locator"]: r["doc_len"] for r in golden.doc_stats.collect()} == {0: 2, 127: 3, 255: 6}
    assert golden.c == 11
    assert all(r["cf"] == 1 for r in golden.lexicon.collect())


def test_all_stop_terms_score_zero(golden):
    assert [(r["cid"], r["score"]) for r in Planner(golden).search("trump event").collect()] == [(11, 0.0), (10, 0.0)]


def test_scores_by_hand(spark, tmp_path):
    texts = ["apple pie apple", "apple tart", "plum pie", "apple tart", "fig"]
    index = ix.build(comments(spark, [(i, i, t) for i, t in enumerate(texts)]), str(tmp_path))
    planner = Planner(index, stop_share=10.0, mu=5.0)
    assert index.c == 10

    def score(text, words, cf):
        w = text.split()
        return round(sum(math.log((w.count(x) + 5 * cf[x] / 10) / (len(w) + 5)) for x in words), 6)

    cf = {"apple": 4, "pie": 2}
    asked = ["apple", "pie", "apple"]
    expected = sorted(((score(t, asked, cf), i) for i, t in enumerate(texts) if set(t.split()) & set(asked)), reverse=True)
    got = [(r["score"], r["locator"]) for r in planner.search("apple pie apple missing").collect()]
    assert got == expected
    assert [r["locator"] for r in planner.search("apple", 2).collect()] == [r["locator"] for r in planner.search("apple").collect()][:2]
    ties = [r["locator"] for r in planner.search("tart").collect()]
    assert ties == [3, 1]
    assert planner.search("missing").count() == 0


def test_stop_terms_are_retrieved_but_not_scored(spark, tmp_path):
    index = ix.build(comments(spark, [(i, i, "the " * 50 + f"w{i}x" * 3) for i in range(20)]), str(tmp_path))
    rows = Planner(index).search("the").collect()
    assert len(rows) == 20 and {r["score"] for r in rows} == {0.0}


def test_term_lengths(spark, tmp_path):
    words = ["a" * n for n in (1, 2, 126, 127, 128, 129)]
    index = ix.build(comments(spark, [(1, 1, " ".join(words))]), str(tmp_path))
    assert sorted(len(r["term"]) for r in index.lexicon.collect()) == [2, 126]
    assert index.c == 6


def test_posting_bytes_are_the_coded_length(spark, tmp_path):
    index = ix.build(comments(spark, [(i * 137, i, "red blue red green"[: 8 + i]) for i in range(12)]), str(tmp_path))
    lines: dict[str, str] = {}
    for r in index.postings.orderBy("term", "locator").collect():
        lines[r["term"]] = lines.get(r["term"], "") + f"\a{r['locator']}," + ",".join(map(str, r["positions"]))
    codes = {s: f"0{i:02b}" for i, s in enumerate(SHORT)} | {s: f"1{i:03b}" for i, s in enumerate(LONG)}
    for r in index.lexicon.collect():
        line = f"{r['cf']}{lines[r['term']]}"
        assert r["posting_bytes"] == len(codec.encode(line, codes))
        assert codec.decode(codec.encode(line, codes), codes) == line


def test_properties(spark, tmp_path):
    from conftest import SF
    from termloom.plans import catalog

    index = catalog.index_of(spark, SF)
    p = Planner(index)
    ids = lambda q: {r["locator"] for r in p.search(q).collect()}
    a, b = ids("ntea AND ntea"), ids("oure AND oure")
    assert ids("ntea AND oure") == a & b and ids("ntea OR oure") == a | b and ids("oure NOT ntea") == b - a
    terms = [r["term"] for r in index.lexicon.where(F.col("term").startswith("ntea")).collect()]
    assert ids("ntea*") == {r["locator"] for r in index.postings.where(F.col("term").isin(terms)).collect()}
    assert index.lexicon.agg(F.sum("cf")).first()[0] == index.postings.agg(F.sum("tf")).first()[0]
    holding = {r["locator"] for r in index.comments.where(F.contains(F.lower("text"), F.lit("attion to"))).collect()}
    assert ids("'attion to'") <= holding
    best = p.search("ntea oure", 3)
    assert p.texts(best).count() == 3


def test_replies(spark, tmp_path):
    rows = [(1, 100, "root", None), (2, 101, "left reply", 100), (3, 102, "right reply", 100), (4, 103, "deep", 101)]
    index = ix.build(comments(spark, rows, True), str(tmp_path))
    p = Planner(index)
    assert [r["cid"] for r in p.search("ReplyTo:100").orderBy("cid").collect()] == [101, 102]
    assert [r["cid"] for r in p.search("ReplyTo:100 AND 'right re'*").collect()] == [102]
    assert p.search("ReplyTo:999").count() == 0
    assert ix.reply_index(comments(spark, rows, True)).count() == 2


def test_empty_corpus(spark, tmp_path):
    index = ix.build(comments(spark, []), str(tmp_path))
    assert index.c == 0 and Planner(index).search("any thing").count() == 0


@pytest.mark.parametrize(
    ("word", "expected"),
    [("consign", "consign"), ("consigned", "consign"), ("consistency", "consist"), ("knightly", "knight"), ("knots", "knot"), ("generally", "general"), ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"), ("hopping", "hop"), ("hoping", "hope"), ("luxuriated", "luxuri"), ("sky", "sky"), ("dying", "die"), ("by", "by"), ("say", "say"), ("happy", "happi"), ("relational", "relat"), ("characters", "charact"), ("community", "communiti"), ("succeed", "succeed"), ("skies", "sky"), ("bliss", "bliss"), ("controlling", "control"), ("adjustment", "adjust")],
)
def test_stems(word, expected):
    assert stem(word) == expected


def test_derived_code_round_trip(spark):
    text = "to be or not to be, that is the question"
    codes = codec.code_table(spark.createDataFrame([(text,), (None,)], "t string"), "t")
    assert codec.decode(codec.encode(text, codes), codes) == text
    assert len(codes[" "]) <= len(codes["q"])
    assert codec.derive({"x": 3}) == {"x": "0"}


def test_batch_equals_single(spark):
    from conftest import SF
    from termloom.plans import catalog

    p = Planner(catalog.index_of(spark, SF, PLAIN))
    batch = p.search_batch([(0, "ntea oure"), (1, "ntea*")], 5)
    for i, q in enumerate(("ntea oure", "ntea*")):
        assert [(r["cid"], r["score"]) for r in batch.where(F.col("query_id") == i).orderBy("rank").collect()] == [(r["cid"], r["score"]) for r in p.search(q, 5).collect()]
    assert ranking.first_n(batch, 2).count() == 2


def test_phrase_reads_the_texts_of_its_candidates(spark):
    from conftest import SF
    from termloom.plans import catalog

    index = catalog.index_of(spark, SF)
    plan = Planner(index).search("'eriner thanea'")._jdf.queryExecution().optimizedPlan().toString()
    assert "contains(lower(text" in plan.lower() and ("locator" in plan and (" IN (" in plan or " INSET " in plan))
    assert Planner(index).search("'eriner zzzzunknown'").count() == 0


def test_too_many_symbols_are_an_error(spark, monkeypatch):
    from termloom.operators import codec

    df = spark.createDataFrame([("abca",)], "text string")
    assert set(codec.code_table(df, "text")) == {"a", "b", "c"}
    monkeypatch.setattr(codec, "MOST_SYMBOLS", 2)
    with pytest.raises(ValueError):
        codec.code_table(df, "text")
