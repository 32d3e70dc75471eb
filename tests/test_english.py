import pyarrow as pa
from pyspark.sql import functions as F

from termloom.functions import analysis, porter2
from termloom.functions.analysis import english_tokens
from termloom.functions.porter2 import stem


def test_each_different_token_is_stemmed_once():
    porter2.remembered.cache_clear()
    rows = [["zebras", "running"] * 50, [], ["running", "."], ["zebras"]]
    tokens = pa.array(rows, pa.list_(pa.string()))
    want = [[stem(t) for t in row] for row in rows]
    assert analysis._stemmed.func(tokens).to_pylist() == want
    assert porter2.remembered.cache_info().misses == 3
    # other batches of the same process, parts of arrays among them
    assert analysis._stemmed.func(tokens.slice(1, 2)).to_pylist() == want[1:3]
    assert porter2.remembered.cache_info().misses == 3
    assert analysis._stemmed.func(tokens.slice(0, 0)).to_pylist() == []


def test_tokens_of_odd_texts(spark):
    texts = {
        "": "", "a.b, 1,000? Yes": "a.b , 1,000 ? yes", "x,?«y»": "x , ? « y »", "say 'so'. no: 12:30 http://a": "say ' so' . no : 12:30 http://a",
        "wait... what--ever. ": "wait .. . what -- ever .", "a\xa0b!\n[c]": "a b ! [ c ]", "end.": "end .", ". .": ". .",
    }
    got = {r["text"]: r["tokens"] for r in spark.createDataFrame([(t,) for t in [*texts, None]], "text string").select("text", english_tokens(F.col("text")).alias("tokens")).collect()}
    assert got == {t: [stem(w) for w in tokens.split()] for t, tokens in texts.items()} | {None: []}


def test_every_mark_is_separated(spark):
    marks = "،;؛¿!\"])}»›”؟¡%٪°±©®।॥…([{“‘„‚«‹「『?"
    rows = [(f"{first}{m}b{m}{m}9{m},7", m) for m in marks for first in "aé"]
    got = spark.createDataFrame(rows, "text string, mark string").select("text", "mark", english_tokens(F.col("text")).alias("tokens")).collect()
    assert all(r["tokens"] == [r["text"][0], r["mark"], "b", r["mark"], r["mark"], "9", r["mark"], ",7"] for r in got)


def test_rare_separations_run_only_where_they_may_change_something(spark):
    plan = spark.createDataFrame([], "text string").select(english_tokens(F.col("text")).alias("tokens"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("THEN regexp_replace") == plan.count("regexp_replace") - 1 > 1
