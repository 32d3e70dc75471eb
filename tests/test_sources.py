from pyspark.sql import functions as F

from termloom.functions import cleaning
from termloom.operators import pages as pg
from termloom.operators import vectors
from termloom.sources import comments as src
from termloom.streaming import ingest
from termloom.timing import Timer


def test_normalised_comments(spark, tmp_path):
    path = tmp_path / "comments.csv"
    path.write_text('1,5,7,"two ""words""\n\nand a line",2016-01-01,,3,1\n2,5,8,short,2016-01-02,1\n3,6,8,votes,2016-01-03,None,4\n', encoding="utf-8")
    rows = src.read_comments(spark, str(path)).orderBy("cid").collect()
    assert [r["text"] for r in rows] == ['two "words"\n\nand a line', "short", "votes"]
    assert [(r["parent_cid"], r["upvotes"], r["downvotes"]) for r in rows] == [(None, 3, 1), (1, 0, 0), (None, 4, 0)]


def test_crawled_round_trip_and_normalising(spark, tmp_path):
    rows = [(1, "http://x/1", "ann", "t", "None", 2, 0, 'say "hi"\nthere'), (2, "http://x/1", "bob", "t", "1", 0, 1, "yes")]
    df = spark.createDataFrame(rows, "cid long, url string, author string, ts string, parent string, upvotes int, downvotes int, text string")
    src.write_crawled(df.coalesce(1), str(tmp_path / "out"))
    back = src.read_crawled(spark, str(tmp_path / "out"))
    assert [r["text"] for r in back.orderBy("cid").collect()] == [r[7] for r in rows]
    comments, articles, authors = src.normalise(back)
    assert comments.count() == 2 and articles.count() == 1
    assert [tuple(r) for r in authors.orderBy("author_id").collect()] == [(0, "ann"), (1, "bob")]


def test_dump(spark, tmp_path):
    path = tmp_path / "dump.csv"
    path.write_text("a1,u1,11,first text,,2016,3\narticle_id,author_id,comment_id,comment_text,parent_comment_id,timestamp,upvotes\na1,u2,12,second,11,2016,0\n")
    rows = src.read_dump(spark, str(path)).orderBy("comment_id").collect()
    assert [tuple(r)[:4] for r in rows] == [("11", "a1", "u1", "first text"), ("12", "a1", "u2", "second")]


def test_id_list(spark, tmp_path):
    (tmp_path / "a.csv").write_text("0,http://x,y\n1,b\n")
    ids = src.read_id_list(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in ids.orderBy("id").collect()] == [(0, "http://x,y"), (1, "b")]
    assert tuple(src.id_list_gaps(ids).first()) == (2, 0, 1, 2)


def test_query_file_and_lenient_text(spark, tmp_path):
    (tmp_path / "q.txt").write_text("first one \n\nb AND c\n")
    assert [r["query"] for r in src.read_queries(spark, str(tmp_path / "q.txt")).orderBy("query_id").collect()] == ["first one", "b AND c"]
    (tmp_path / "bad.txt").write_bytes(b"ab\xffcd\n\nnext\n")
    (tmp_path / "latin.txt").write_bytes("caf\xe9\n\nna\xefve\n".encode("latin-1"))
    assert [r["text"] for r in src.read_lines(spark, str(tmp_path / "latin.txt")).collect()] == ["café", "", "naïve"]
    assert [r["value"] for r in src.read_lenient_text(spark, str(tmp_path / "bad.txt")).collect()] == ["abcd", "", "next"]


def test_seed_urls(spark):
    urls = {r["url"] for r in src.seed_urls(spark, "http://x/").collect()}
    assert len(urls) == 660 and "http://x/20150101.html" in urls and "http://x/20161130.html" in urls and not any(u[13:15] == "12" or u.endswith("31.html") for u in urls)


def test_cleaning(spark):
    marks = "".join(cleaning.FULLWIDTH)
    df = spark.createDataFrame([(marks, 'x"a","b "c" d","e"x')], "t string, line string")
    row = df.select(cleaning.ascii_punctuation(F.col("t")).alias("t"), cleaning.repaired_fields(F.col("line")).alias("f")).first()
    assert row["t"] == "".join(cleaning.FULLWIDTH.values())
    assert row["f"] == ['"a', 'b "c" d', 'e"']
    assert cleaning.one_line_rows(spark.createDataFrame([("a\nb", 1)], "t string, n int")).first()["t"] == "a b"
    counted = cleaning.field_counts(spark.createDataFrame([("a,b",), ("a",)], "v string"), F.split("v", ","), 2, 2)
    assert tuple(counted.first()) == (1, 2)


def test_conflicting_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "cid long, text string")
    assert [tuple(r) for r in src.conflicting_ids(df).collect()] == [(2, 2)]


HTML = """<div class="comment-section__item"><a class="pager__button pager__button--next" href="/a?page=2">more</a></div>
<div class="comment__container"><span data-url="/replies/7"></span></div>
<article class="comment js-comment"><div class="comment-meta__name"><a href="http://u/profile/Ann">Ann</a></div>
<a class="comment-meta__date" href="/a#cid-7">#12&nbsp;of 30</a>
<div class="comment__body"><p> one <br> two &amp; three</p></div><span class="js-comment-recommendations">4</span>
<div class="comment__reactions"><a class="comment__origin js-jump-to-comment" href="#cid-3">to <strong>a</strong><strong> #5 </strong></a></div></article>
<article class="comment"><div class="comment__body">alone</div></article><article class="other">no</article>"""


def test_comment_fields(spark):
    df = spark.createDataFrame([("http://x/a?p=1#top", HTML), ("http://x/b", None)], "url string, html string")
    rows = [tuple(r) for r in pg.comment_fields(df).collect()]
    assert rows == [("http://x/a", "http://u/profile/Ann", "Ann", "one\ntwo & three", 4, "12", "#5", "7", "3"), ("http://x/a", "", "", "alone", 0, "", None, None, None)]
    assert [tuple(r)[1:] for r in pg.navigation(df).collect()] == [("/a?page=2", ["/replies/7"]), (None, [])]
    other = spark.createDataFrame([("u", '<a class="x zb-pager__btn-rel-next" href="n">')], "url string, html string")
    assert pg.navigation(other).first()["next_page"] == "n"


def test_paged_threads(spark):
    """Posts of a thread come in pages, each naming the next."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    from termloom.sources import threads

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            n = int(q["cursor"][0].split(":")[0])
            posts = [{"id": str(n * 10 + i), "author": {"name": 'A "x"'}, "createdAt": "t", "parent": None if i else n, "likes": i, "dislikes": 0, "raw_message": f"{q['thread'][0]} {n}"} for i in range(2)]
            body = json.dumps({"response": [*posts, posts[0]], "cursor": {"hasNext": n < 2, "next": f"{n + 1}:0:0"}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    pages = spark.createDataFrame([("http://x/1", "5")], "url string, thread_id string")
    got = threads.fetch(pages, f"http://127.0.0.1:{server.server_port}/?thread={{thread}}&cursor={{cursor}}", pause=0)
    assert sorted((r["cid"], r["text"], r["parent_cid"]) for r in got.collect()) == [(0, "5 0", 0), (1, "5 0", None), (10, "5 1", 1), (11, "5 1", None), (20, "5 2", 2), (21, "5 2", None)]
    server.shutdown()


def test_crawl_depth(spark):
    pages = [(i, f"http://a.org/{i}", f'<a href="/{i + 1}">n</a><a href="http://b.org/x">x</a>') for i in range(8)]
    found = pg.crawl(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame([("http://a.org/0",)], "url string"), "a.org")
    assert sorted((r["url"], r["depth"]) for r in found.collect()) == [(f"http://a.org/{i}", i) for i in range(5)]


def test_nearest(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 2.0]), (4, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vectors.nearest_to(df, k=2).collect()] == [(2, 0.0), (3, 0.292893)]


def test_word_vectors(spark, tmp_path):
    texts = spark.createDataFrame([("red green blue " * 5,), ("red yellow blue " * 5,)], "text string")
    model = vectors.train_word_vectors(texts, size=8, min_count=1, passes=1, partitions=1)
    assert len(vectors.infer(model, texts).first()["vector"]) == 8
    from pyspark.ml.feature import Word2VecModel

    model.write().save(str(tmp_path / "model"))
    again = vectors.infer(Word2VecModel.load(str(tmp_path / "model")), texts)
    assert again.first()["vector"] == vectors.infer(model, texts).first()["vector"]


def test_training_texts(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c,d\n1,2,3,"x\ny"\n1,2,3,z\n')
    assert [r["text"] for r in src.training_texts(spark, str(tmp_path / "t.csv"), 1).collect()] == ["x\ny"]


def test_streaming_index(spark, tmp_path):
    from termloom.plans.planner import Planner

    source, out = tmp_path / "in", tmp_path / "index"
    schema = "locator long, cid long, text string"
    for batch in ([(1, 1, "red apple"), (2, 2, "green pear")], [(3, 3, "red pear")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(source))
        ingest.start(spark.readStream.schema(schema).parquet(str(source)), str(out), str(tmp_path / "state")).awaitTermination()
    index = ingest.load(spark, str(out))
    assert (index.c, index.n_docs) == (6, 3)
    assert [r["cid"] for r in Planner(index).search("red AND pear").collect()] == [3]


def test_timer():
    t = Timer()
    with t.phase("a"):
        pass
    assert t.timed("b")(lambda: 5)() == 5
    assert [r[0] for r in t.report()][-1] == "total"


def test_cli(spark, tmp_path, capsys):
    from termloom import cli

    (tmp_path / "c.csv").write_text("1,1,1,red apple,t,\n2,1,1,green apple,t,1\n")
    (tmp_path / "q.txt").write_text("apple\nred AND apple\nReplyTo:1\n")
    cli.main(["index", str(tmp_path / "c.csv"), str(tmp_path / "i")])
    cli.main(["search", str(tmp_path / "i"), str(tmp_path / "q.txt"), "--printIdsOnly", "--topN", "5"])
    assert capsys.readouterr().out.split() == ["2,1", "1", "2"]
