from pyspark.sql import functions as F

from termloom.operators import grouping
from termloom.operators import index as ix


def expected(docs):
    """{(term, locator, doc_len): (positions, bits)} by brute force; rows that share a locator and a length are one."""
    places = {}
    for locator, tokens in docs:
        for i, t in enumerate(tokens):
            if 2 <= len(t) <= 126:
                places.setdefault((t, locator, len(tokens)), []).append(i)

    def bits(locator, positions):
        text = ",".join(map(str, [locator, *positions]))
        return 4 + sum(3 if c in "123," else 4 for c in text)

    return {k: (sorted(p), None if k[1] is None else bits(k[1], sorted(p))) for k, p in places.items()}


def rows_of(df):
    rows = df.collect()
    got = {(r["term"], r["locator"], r["doc_len"]): (r["positions"], r["bits"]) for r in rows}
    assert len(got) == len(rows) and all(r["tf"] == len(r["positions"]) for r in rows)
    return got


DOCS = [
    (3, ["the", "a", "cat", "the", "é" * 126, "𝒳𝒳", "x" * 127, "the"]), (-12, ["the"] * 1200), (0, []), (1 << 40, ["𝒳", "𝒳𝒳", "zz", "to"] * 30), (7, [f"w{i}" for i in range(40)]), (8, ["a"]),
]
SHARED = [(5, ["the", "cat"]), (5, ["cat", "cat"]), (5, ["cat"]), (None, ["to", "the"]), (None, ["the", "the"])]


def test_postings_are_grouped_in_the_row(spark, monkeypatch):
    monkeypatch.setattr(grouping, "TOKENS_AT_ONCE", 100)
    docs = spark.createDataFrame(DOCS, "locator long, tokens array<string>")
    postings = ix.postings_of(docs)
    assert rows_of(postings) == expected(DOCS)
    plan = postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan  # no shuffle and no sort of token rows


def test_rows_that_share_a_locator(spark):
    docs = spark.createDataFrame(DOCS + SHARED, "locator long, tokens array<string>")
    assert rows_of(ix.postings_of(docs)) == expected(DOCS + SHARED)
    assert ix.postings_of(docs.limit(0)).count() == 0
    assert rows_of(ix.postings_of(spark.createDataFrame(SHARED[3:4], docs.schema))) == expected(SHARED[3:4])


def test_pieces_hold_every_row_once():
    for lengths in ([], [0], [0, 0, 5, 200, 0, 60, 60, 1], [300]):
        offsets = grouping.np.cumsum([0, *lengths])
        rows = [i for a, b in grouping._pieces(offsets, 100) for i in range(a, b)]
        assert rows == list(range(len(lengths)))
        assert all(offsets[b] - offsets[a] <= 100 or b == a + 1 for a, b in grouping._pieces(offsets, 100))


def test_ranges_grow_with_the_tokens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "TOKENS_A_RANGE", 300)
    texts = [(i, i, f"the the to w{i} v{i % 7} " + " ".join(f"u{(i * j) % 50}" for j in range(6))) for i in range(300)]
    comments = spark.createDataFrame(texts, "locator long, cid long, text string")
    index = ix.build(comments, str(tmp_path / "plain"))
    assert rows_of(index.postings) == expected([(i, text.split()) for i, _, text in texts])
    files = index.postings.groupBy(F.input_file_name()).agg(F.min(F.struct("term", "locator")).alias("low"), F.max(F.struct("term", "locator")).alias("high"), F.count("*").alias("n")).orderBy("low").collect()
    assert 9 <= len(files) <= 11 and max(f["n"] for f in files) < 600
    assert all(tuple(a["high"]) < tuple(b["low"]) for a, b in zip(files, files[1:]))
    # terms of more postings than a range holds are spread
    assert index.postings.where("term IN ('the', 'to')").select(F.input_file_name()).distinct().count() >= 3

    shared = comments.unionByName(comments.where("locator % 3 = 0").withColumn("text", F.concat("text", F.lit(" again"))))
    twice = ix.build(shared, str(tmp_path / "shared"))
    assert rows_of(twice.postings) == expected([(i, t.split()) for i, _, t in texts] + [(i, t.split() + ["again"]) for i, _, t in texts if i % 3 == 0])
