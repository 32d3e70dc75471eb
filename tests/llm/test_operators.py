"""The training-data operators against plain Python on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF, compare
from termloom.llm import ann, bytewords, chat, common, decontam, langid, licenses, neardup, packing, quality, queries, toxicity, urls

WORD = re.compile(common.WORD)
LOWER = str.maketrans(common.UPPER, common.LOWER)
EXTRA = "score double, words string, row_id long, hash long, n int, rank int, node long, bucket int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def edge_documents(spark, more=()):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    texts = [None, "", "  \n\t", "word", "Ünï çødé 123", long, "the same text stands here twice over", "the same text stands here twice over", "!!! ###", "x" * 100_000, *more]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[6], (None, "no id but a text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lang = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")
    return df.select("*", lang.alias("lang"), F.lit("s").alias("source"), *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in EXTRA.split(", "))), rows


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# words and hashes


def test_words_and_ngrams_match_the_pattern():
    texts = ["Ab c-d", "", None, "é1 É x_y", "a b c d e f"]
    data, offsets = bytewords.column_bytes(pa.array(texts, pa.string()))
    hashes, row, count = bytewords.words(data, offsets)
    expected = [w for t in texts for w in words(t)]
    assert count.tolist() == [len(words(t)) for t in texts]
    by_word = {}
    for w, h in zip(expected, hashes.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    grams, gram_row = bytewords.ngrams(hashes, row, 3)
    assert Counter(gram_row.tolist()) == {i: max(0, len(words(t)) - 2) for i, t in enumerate(texts) if len(words(t)) > 2}


# op1


def brute_nearest(rows, k):
    good = {}
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v) and len(v) == 16:
            good.setdefault(i, np.array(v, np.float32).astype(float))
    out = []
    for q in sorted(i for i in good if i % 20 == 0):
        best = sorted(((-float(good[q] @ v), i) for i, v in good.items() if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_nearest_recall_and_edges(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(16)]) for i in range(1500)]
    rows[7] = (7, rows[20][1])  # the same vector
    rows += [(2000, None), (2020, [0.0] * 16), (2040, [None, *[1.0] * 15]), (2060, [float("nan")] * 16), (2080, [1.0] * 5), (2100, [float("inf")] * 16), rows[40]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("rank", F.lit(1))
    found = ann.nearest(df, "vec_id", "embedding", lambda i: i % 20 == 0, k=20).collect()
    expected = brute_nearest(rows, 20)
    assert Counter(r["query_id"] for r in found) == Counter(q for q, *_ in expected)
    assert sorted(r["rank"] for r in found if r["query_id"] == 0) == list(range(1, 21))
    pairs = {(q, i): s for q, _, i, s in expected}
    assert sum((r["query_id"], r["id"]) in pairs for r in found) / len(pairs) >= 0.9
    assert all(abs(r["score"] - pairs[r["query_id"], r["id"]]) < 1e-12 for r in found if (r["query_id"], r["id"]) in pairs)


def test_nearest_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [0.5, 0.1])]
    df = spark.createDataFrame(rows, schema)
    found = ann.nearest(df, "vec_id", "embedding", lambda i: i % 20 == 0)
    assert rows_of(found, "rank", "id", "score") == [(1, 2, 1.0), (2, 3, 1.0), (3, 5, 0.5)]
    assert ann.nearest(spark.createDataFrame([], schema), "vec_id", "embedding", lambda i: i % 20 == 0).count() == 0


def test_op1_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in common.table(spark, SF, "embeddings").collect()]
    found = {(r["query_id"], r["vec_id"]) for r in queries.op1_nearest_vectors(spark, SF).collect()}
    good = {i: np.array(v, float) for i, v in rows}
    expected = set()
    for q in (i for i in good if i % 20 == 0):
        expected |= {(q, i) for _, i in sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q)[:20]}
    assert len(found) == len(expected) and len(found & expected) / len(expected) >= 0.9


def test_several_blocks_and_an_id_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BLOCK", 16 * 1024)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 64)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.standard_normal((4000, 16)) * np.exp(0.3 * rng.standard_normal(4000))[:, None])]
    rows += [rows[40]] * 500 + [(60, [9.0] * 16), (60, [float(x) for x in range(16)])] * 20
    first = {40: rows[40][1], 60: min(v for i, v in rows if i == 60)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {(r["query_id"], r["id"]) for r in ann.nearest(df, "vec_id", "embedding", lambda i: i % 20 == 0).collect()}
    expected = {(q, i) for q, _, i, _ in brute_nearest([(i, first.get(i, v)) for i, v in rows], 20)}
    assert len(found) == len(expected) and len(found & expected) / len(expected) >= 0.9


@pytest.mark.parametrize("copies", [300, 2000])
def test_smallest_ids_of_equal_vectors(copies):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((6000, 64)).astype(np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    same = np.sort(rng.permutation(6000)[:copies])
    v[same] = v[same[0]]
    ids, asked = rng.permutation(6000) + 10, same[::50]
    found = ann.search_block(ids, v, ids[asked], v[asked], 1.0)
    for q in ids[asked]:
        assert found[1][found[0] == q].tolist() == [i for i in sorted(ids[same]) if i != q][: ann.K]


@pytest.mark.parametrize("spread", [0.0, 0.2, 0.5])
def test_recall_on_uneven_norms(spread):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((10_000, 64))
    if spread:
        v *= (np.exp(spread * rng.standard_normal(10_000)) / np.linalg.norm(v, axis=1))[:, None]
    ids, asked = np.arange(10_000), rng.permutation(10_000)[:100]
    found = ann.search_block(ids, v, asked, v[asked], np.linalg.norm(v, axis=1).max())
    score = v[asked] @ v.T
    score[np.arange(100), asked] = -np.inf
    expected = {(q, i) for q, row in zip(asked, np.argsort(-score, axis=1)[:, :20], strict=True) for i in row}
    assert len(expected & set(zip(*found[:2], strict=True))) / len(expected) >= 0.9


# op2


def events(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, seq long, turn long, role string, op string, text string").withColumn("n", F.lit("x"))


def test_chat_folding(spark):
    log = events(
        spark,
        [
            (1, 1, 0, "user", None, "Hi <turn x> \\l"), (1, 2, 1, "assistant", "delta", "Hel"), (1, 3, 1, None, "delta", "lo"), (1, 4, 1, None, "regenerate", None), (1, 5, 1, None, "delta", "Good "), (1, 6, 1, None, "delta", "day</turn>\n"),
            (1, 7, 0, "user", "edit", "Hey"), (2, 1, 0, None, "message", None), (2, 2, 0, "assistant", "message", "a"), (2, 3, 0, "assistant", "message", "a"), (None, 1, 0, "user", "message", "null id"),
        ],
    )
    formatted = chat.format_log(log).withColumn("turns", chat.read_back(F.col("formatted")))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in formatted.collect()}
    assert got == {1: [("user", "Hey"), ("assistant", "Good day</turn>\n")], 2: [("", ""), ("assistant", "a"), ("assistant", "a")], None: [("user", "null id")]}
    for r in formatted.collect():
        for s, (_, text) in zip(r["loss_spans"], [t for t in got[r["conv_id"]] if t[0] == "assistant"], strict=True):
            coded = r["formatted"][s["start"] : s["end"]]
            assert coded.replace("\\g", ">").replace("\\l", "<").replace("\\b", "\\") == text
    assert chat.format_log(events(spark, [])).count() == 0


def test_chat_round_trip_of_control_strings(spark):
    random.seed(3)
    parts = ["<turn ", "</turn>\n", "\\", "\\l", "\\b", "\\g", ">", "<", "é", "\U0001f600", "\n", "a"]
    texts = ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(300)]
    rows = [(i // 3, i, i, random.choice(["user", "assistant", "a>b"]), "message", t) for i, t in enumerate(texts)]
    back = chat.format_log(events(spark, rows)).withColumn("turns", chat.read_back(F.col("formatted"))).collect()
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in back}
    assert got == {c: [(r[3], r[5]) for r in rows if r[0] == c] for c in got} and len(got) == 100


def test_op2_op7_op8_sql(spark, duck):
    for name in queries.ORACLE_SQL:
        compare(queries.QUERIES[name](spark, SF), duck, queries.ORACLE_SQL[name])


# op3


def checked_packing(df, documents, capacity=packing.CAPACITY):
    """The rows of a packing after all that must hold of it was checked."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = df.collect()
    expected = []
    for doc, text in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((doc, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(expected, key=str)
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return got, len(by_sequence)


def test_packing_edges(spark):
    df, rows = edge_documents(spark, ["a <|endoftext|> b", "don't  STOP\u00a0now", "e\u0301 ﬁ ½"])
    checked_packing(packing.pack(df, queries.tokenizer_path()), rows)
    assert packing.pack(empty_documents(spark), queries.tokenizer_path()).count() == 0


def test_ids_of_parts_are_the_tokenizers_own():
    """Hard strings, with a cache so small that its halves change all the time; a vocabulary of other rules too."""
    from array import array

    import public_tokenizers
    from tokenizers import Tokenizer

    draw = random.Random(5)
    bits = [*"abcxyzABZ019.,;:!?'\"-_()<>|/ \t\n\x1c\x1f\x7f\x0b", "'s", "'ll", "<|endoftext|>", "<|", "é", "É", "ß", "ſ", "İ", "你", "\u0301", "½", "word.", "3.14", "e.g.", "http://a.b/c?d=1", "rock'n'roll"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(3000)]
    for path, by_parts in ((queries.tokenizer_path(), True), (public_tokenizers.path("byte_bpe_50k.json"), False)):
        words, whole = packing.WordIds(path, 20), Tokenizer.from_file(path)
        assert words.by_parts == by_parts
        for text in texts:
            assert words.encode(text) == array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
            assert len(words) <= 11


def test_op3(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()]
    got, sequences = checked_packing(queries.op3_pack(spark, SF), rows)
    total = sum(r["length"] for r in got)
    assert sequences <= -(-total // packing.CAPACITY) * 1.02 + 1


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_all(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 257])
    histogram = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 40))}
    room: dict = {}
    ranks: dict = {}
    for n, rank, count, first, offset, copies in packing.plan(histogram, capacity, groups=6):
        ranks.setdefault(n, []).append((rank, count))
        for i in range(count):
            room.setdefault(first + i // copies, []).append((offset + i % copies * n, n))
    for n, parts in ranks.items():
        assert sum(c for _, c in parts) == histogram[n] and sorted(r for r, c in parts) == sorted(np.cumsum([0, *[c for _, c in sorted(parts)]])[:-1].tolist())
    assert set(ranks) == set(histogram)
    for places in room.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= capacity


# op4, op6


def labels_of(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


@pytest.mark.parametrize(("operator", "name"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_edges(spark, operator, name):
    df, rows = edge_documents(spark)
    labels = labels_of(spark, [(i, i % 2) for i in range(10)] + [(3, None), (None, 1)], name)
    got = operator.classify(df, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0)
    assert len({r["score"] for r in got if r["doc_id"] in (6, 7)}) == 1
    assert operator.classify(empty_documents(spark), labels).count() == 0
    assert operator.classify(df, labels_of(spark, [], name)).count() == len(rows)


def auc(marks, scores):
    pairs = [(s, t) for s, m in zip(scores, marks, strict=True) for t, o in zip(scores, marks, strict=True) if m > o]
    return sum((s > t) + (s == t) / 2 for s, t in pairs) / len(pairs)


@pytest.mark.parametrize(("name", "column"), [("op4_quality", "quality"), ("op6_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, column):
    sf = "/root/testdata/sf0.1"
    scored = queries.QUERIES[name](spark, sf).where("held_out").join(common.table(spark, sf, "labels"), "doc_id").collect()
    assert auc([r[column] for r in scored], [r["score"] for r in scored]) >= 0.95
    assert sum(r[column] == r["predicted"] for r in scored) / len(scored) >= 0.95


def test_training_is_bounded_where_ids_repeat(spark):
    rows = [(i % 7, f"text {i} of many") for i in range(400)] + [(i, f"other {i}") for i in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    sample, counts = common.sampled_by_class(labels, "quality", 50)
    assert counts == {0: 150, 1: 150} and sorted(r["count"] for r in sample.groupBy("quality").count().collect()) == [50, 50]
    got = common.training_texts(df.join(labels, "doc_id"), "quality")
    assert len(got) == len({r["doc_id"] for r in got}) == 207
    bounded = common.training_texts(df.join(labels, "doc_id"), "quality", most_bytes=100)
    assert 0 < sum(len(r["text"]) for r in bounded) <= 100


def test_toxic_texts_of_every_language_are_found(spark):
    sf = "/root/testdata/sf0.1"
    documents = common.table(spark, sf, "documents").select("doc_id", "lang")
    scored = queries.op6_toxicity(spark, sf).where("held_out").join(common.table(spark, sf, "labels"), "doc_id").join(documents, "doc_id").collect()
    for lang in ("en", "de", "fr", "es"):
        found = {y: [r["predicted"] for r in scored if r["lang"] == lang and r["toxic"] == y] for y in (0, 1)}
        assert np.mean(found[1]) >= 0.75, lang
        assert np.mean(found[0]) <= 0.02, lang


@pytest.mark.parametrize("size", [10_000, 200_000])
def test_toxic_passages_in_long_clean_texts(spark, size):
    documents, labels = (common.table(spark, "/root/testdata/sf0.1", name) for name in ("documents", "labels"))
    model = toxicity.fit(documents, labels)
    held = documents.where("lang = 'en'").where(common.id_remainder("doc_id", 5) == 0).join(labels, "doc_id").orderBy("doc_id").select("toxic", "text").collect()
    clean, short = [r["text"] for r in held if r["toxic"] == 0], [r["text"] for r in held if r["toxic"] == 1 and len(r["text"]) < 2000]
    passages = [t for t, s in zip(short, model.scores(short), strict=True) if s >= 0.5][:20]
    rng = random.Random(2)
    around = [" ".join(rng.choices(clean, k=size // 1000))[:size] for _ in passages]
    mixed = [f"{t[: size // 2]} {p} {t[size // 2 :]}" for t, p in zip(around, passages, strict=True)]
    assert len(passages) == 20 and np.mean(model.scores(mixed) >= 0.5) >= 0.8
    assert np.mean(model.scores(around) >= 0.5) <= 0.1


def test_quality_scores_are_linear_in_ngrams():
    model = quality.train(["good words here and there", "bad !! BAD !! BAD !!"] * 10, [1, 0] * 10)
    s = model.scores(pa.array(["good words here and there", "bad !! BAD !! BAD !!", None, ""]))
    assert s[0] > 0.5 > s[1] and s[2] == s[3]


# op5


def ppm_bits(train: str, text: str) -> float:
    """Code length by dictionaries, byte by byte."""
    fold = lambda s: b"   " + bytes(langid.FOLD[b] for b in s.encode())
    counts: dict = {}
    data = fold(train)
    for i in range(3, len(data)):
        for order in range(4):
            counts.setdefault(data[i - order : i], Counter())[data[i]] += 1
    bits, data = 0.0, fold(text)
    for i in range(3, len(data)):
        for order in range(3, -2, -1):
            if order < 0:
                bits += 8
                break
            seen = counts.get(data[i - order : i])
            if seen is None:
                continue
            n, kinds = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (n + kinds))
                break
            bits -= math.log2(kinds / (n + kinds))
    return bits


def test_code_lengths_are_exact():
    texts = {"x": ["abra cadabra, abra"], "y": ["Zürich über öde äcker zum zug"]}
    model = langid.train(texts)
    for text in ("abracadabra", "zum Öl über den zug", "q", "日本 x", "aaa   zzz"):
        padded, place, _ = langid._padded(*bytewords.column_bytes(pa.array([text])))
        got = model.bits(padded, place).sum(axis=0)
        assert got == pytest.approx([ppm_bits(texts[k][0], text) for k in ("x", "y")], rel=1e-5)


def test_language_edges(spark):
    df, rows = edge_documents(spark, ["1234 --", "日本語"])
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" for i in (0, 1, 2, 8, 10)) and by_id[11]["lang_pred"] in ("en", "de")
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 4 == 2) for r in got)
    assert langid.identify(empty_documents(spark)).count() == 0


def test_op5_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op5_language(spark, sf).where("held_out").join(common.table(spark, sf, "documents"), "doc_id").select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.97


# op7


def brute_rule(host, path, rules):
    met = [(len(h + p), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(met)[2:] if met else (None, None)


def test_trie_against_all_rules():
    random.seed(1)
    hosts = [".".join(random.choices(["a", "b", "org", "com"], k=random.randint(1, 4))) for _ in range(60)]
    paths = ["/" + "/".join(random.choices(["x", "y", "xy", ""], k=random.randint(0, 4))) for _ in range(40)]
    rules = [(random.choice(["allow", "block"]), random.choice(hosts), random.choice(paths)) for _ in range(80)]
    trie = urls.Trie(rules)
    for host in hosts:
        for path in [*paths, ""]:
            assert trie.match(host, path)[1] == brute_rule(host, path, rules)[1]


def test_url_edges(spark):
    cases = {None: ("", ""), "no scheme": ("", ""), "http://A.Org": ("a.org", ""), "http://x.org?q=/es/": ("x.org", ""), "http://example.org/es/1#f": ("example.org", "/es/1"), "h://b.EXAMPLE.org/en/1?x": ("b.example.org", "/en/1"), "://com/de/": ("com", "/de/"), "http://É.com/fr/\n/x": ("É.com", "/fr/\n/x")}
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(1))
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, expected in enumerate(cases.values()):
        assert (got[i]["host"], got[i]["path"]) == expected
        assert got[i]["rule"] == brute_rule(*expected, urls.RULES)[0]
    assert [got[i]["verdict"] for i in (4, 5, 6, 7)] == ["block", "block", "block", "allow"]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


# op8


def brute_hits(documents, items):
    windows: dict = {}
    for item, text in items:
        w = words(text)
        k = min(8, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    out = []
    for doc, text in documents:
        w, found, hit = words(text), set(), set()
        for k in {len(g) for g in windows}:
            for i in range(len(w) - k + 1):
                if there := windows.get(tuple(w[i : i + k])):
                    found |= there
                    hit |= set(range(i, i + k))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("bound", [200_000, 0])
def test_decontamination_against_brute_force(spark, bound):
    rng = random.Random(4)
    draw = lambda n: " ".join(rng.choices("abcd", k=n))  # noqa: E731  # few words: many ties and repeats
    items = [(i, draw(rng.choice([3, 7, 8, 9, 12, 30]))) for i in range(12)] + [(50, None), (51, " "), (52, "Solo")]
    documents = [(i, draw(rng.randint(0, 60))) for i in range(60)] + [(100, items[5][1].upper()), (101, "solo"), (102, None)]
    items[0] = (0, draw(8))
    df = spark.createDataFrame(documents, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    assert rows_of(decontam.report(df, bench, broadcast_rows=bound), *COLUMNS) == brute_hits(documents, items)


def test_decontamination_edges(spark):
    df, rows = edge_documents(spark)
    items = [(1, " ".join(f"w{i % 977}" for i in range(300, 340))), (2, "the same text stands here twice over")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontam.report(df, bench), *COLUMNS) == brute_hits(rows, items)
    assert decontam.report(empty_documents(spark), bench).count() == 0
    assert rows_of(decontam.report(df, bench.limit(0)), *COLUMNS) == brute_hits(rows, [])


def test_native_operators_run_no_python(spark):
    for name in ("op2_chat_format", "op8_decontaminate"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


# op9


def brute_rows(documents, unite):
    """The class number of each row, by comparing all pairs; rows without words have none."""
    sets = []
    for _, text in documents:
        w = words(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    root = list(range(len(documents)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same_id = unite and documents[i][0] is not None and documents[i][0] == documents[j][0]
            if a and b and (same_id or len(a & b) / len(a | b) >= 0.8):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) if a else None for i, a in enumerate(sets)]


def brute_classes(documents):
    """Sorted (doc_id, class_id) of the rows."""
    group = brute_rows(documents, True)
    name = {g: min((d for (d, _), h in zip(documents, group, strict=True) if h == g and d is not None), default=None) for g in set(group) - {None}}
    return sorted(((d, d if g is None else name[g]) for (d, _), g in zip(documents, group, strict=True)), key=str)


def brute_representatives(documents):
    """Sorted ids of the rows that stay."""
    best = {}
    for (d, t), g in zip(documents, brute_rows(documents, False), strict=True):
        if g is not None:
            best[g] = min(best.get(g, (True, 0)), (d is None, d or 0))
    kept = [None if none else d for none, d in best.values()] + [d for d, t in documents if not words(t)]
    return sorted(kept, key=str)


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(9)
    documents = []
    for base in range(12):
        w = [f"v{rng.randint(0, 5000)}" for _ in range(rng.randint(40, 120))]
        for _ in range(rng.randint(1, 9)):
            documents.append((len(documents), " ".join(w)))
            w = list(w)
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 9)}"  # chains: each like the one before
            if rng.random() < 0.4:
                w.append("tail")
    df, edges = edge_documents(spark)
    documents = [(i + 100, t) for i, t in documents]
    df = df.unionByName(spark.createDataFrame(documents, "doc_id long, text string"), allowMissingColumns=True)
    assert rows_of(neardup.classes(df), "doc_id", "class_id") == brute_classes(edges + documents)
    kept = neardup.representatives(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == brute_representatives(edges + documents)
    assert neardup.classes(empty_documents(spark)).count() == 0 and neardup.representatives(empty_documents(spark)).count() == 0


def test_no_text_is_lost_where_ids_repeat_or_are_null(spark):
    text = lambda c, n=30: " ".join(f"{c}{i}" for i in range(n))
    documents = [(3, text("a")), (5, text("a")), (5, text("b")), (9, text("b")), (None, text("c")), (None, text("c")), (None, text("d")), (7, text("d")), (7, text("d")), (8, None), (8, "!"), (8, "!")]
    df = spark.createDataFrame(documents, "doc_id long, text string").withColumn("node", F.lit("x"))
    assert rows_of(neardup.classes(df), "doc_id", "class_id") == brute_classes(documents)
    kept = neardup.representatives(df).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == brute_representatives(documents)
    assert {r["text"] for r in kept} == {t for _, t in documents}


def test_buckets_of_several_blocks(spark, monkeypatch):
    """Classes do not depend on how large a block is, nor on whether keys of many members are broadcast."""
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    documents = []
    for i in range(40):
        w = list(base)
        for at in rng.sample(range(60), rng.randint(0, 3)):
            w[at] = f"x{rng.randint(0, 3)}"
        documents.append((i, " ".join(w)))
    df = spark.createDataFrame(documents, "doc_id long, text string")
    assert rows_of(neardup.classes(df, bands=40, rows=2), "doc_id", "class_id") == brute_classes(documents)
    monkeypatch.setattr(common, "BROADCAST_IDS", 0)
    assert rows_of(neardup.classes(df, bands=40, rows=2), "doc_id", "class_id") == brute_classes(documents)


def test_links_between_leaves_are_found(spark):
    """Two texts alike, both in one bucket with a smaller id that is like neither, or like one only."""
    base = [f"w{i}" for i in range(100)]
    a = base.copy()
    b, c = base.copy(), base.copy()
    b[:2] = ["p", "q"]
    b[50] = "r"
    c[:2] = ["p", "q"]
    c[50], c[80] = "r", "s"
    documents = [(0, " ".join(a)), (1, " ".join(b)), (2, " ".join(c))]
    got = neardup.classes(spark.createDataFrame(documents, "doc_id long, text string"), bands=60, rows=2)
    assert rows_of(got, "doc_id", "class_id") == brute_classes(documents)


def test_op9(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()]
    assert rows_of(queries.op9_near_duplicates(spark, SF), "doc_id", "class_id") == brute_classes(rows)


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    e, w = rng.integers(0, 1 << 63, 200, dtype=np.uint64), rng.uniform(0.2, 6, 200)
    v = w * rng.uniform(0.4, 1.6, 200)
    s = neardup.dart_signatures(np.concatenate([e, e]), np.repeat([0, 1], 200), np.concatenate([w, v]), 3, 3000)
    assert (s[0] == s[1]).mean() == pytest.approx(np.minimum(w, v).sum() / np.maximum(w, v).sum(), abs=0.03)
    assert not s[2].any() and s[:2].all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "x long, y long"), 100).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {99: 98, 100: 98}


# op10


def brute_base(text):
    w = words(text)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


BASE_COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def test_license_base_and_labels(spark):
    texts = ["Licensed under the Apache License, Version 2.0. MIT License! CC-BY", "apache apache license license", "licensed under the very apache license version 2.0", "GNU General Public GNU General Public License", "Released under the MIT license; released under the MIT license"]
    df, rows = edge_documents(spark, texts)
    got = sorted(licenses.scan(df).collect(), key=lambda r: str(r["doc_id"]))
    assert [(r["doc_id"], *(r[c] for c in BASE_COLUMNS)) for r in got] == sorted(((d, *brute_base(t)) for d, t in rows), key=lambda x: str(x[0]))
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[10]["labels"] == "apache,apache-2.0,cc-by,mit" and by_id[12]["labels"] == "apache,apache-2.0" and by_id[13]["labels"] == "gpl"
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(empty_documents(spark)).count() == 0


def brute_labels(text):
    """(labels, score): the best cover of each template by a band of diagonals."""
    w, labels, score = words(text), set(), 0.0
    for templates, is_base in ((licenses.BASE, True), (licenses.LONGER, False)):
        for phrase, label in templates.items():
            t = phrase.split()
            n = len(t) - 1
            voted = {(p - k, k) for p in range(len(w) - 1) for k in range(n) if w[p : p + 2] == t[k : k + 2]}
            drift = 0 if is_base else licenses.DRIFT + n // 8
            cover = max((len({k for d, k in voted if b <= d <= b + drift}) / n for b, _ in {(d - x, 0) for d, _ in voted for x in range(drift + 1)}), default=0)
            if cover >= (1 if is_base else licenses.COVER):
                labels.add(label)
                score = max(score, cover)
    return ",".join(sorted(labels)), score


def test_words_put_in_and_left_out(spark):
    grant = next(p for p, label in licenses.LONGER.items() if label == "mit-grant")
    rng = random.Random(6)
    texts = [grant.replace("any person", "any xx yy person"), grant.replace("any person", "any of this person"), grant.replace("any person", "any one two three person")]
    for phrase in [*licenses.LONGER, *licenses.BASE] * 6:
        w = phrase.split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choices(["of", "this", "license", "the", "zz"], k=rng.randint(0, 3))
            if rng.random() < 0.4:
                w.pop(rng.randrange(len(w)))
        texts.append(" ".join([*rng.choices(["of", "the", "license", "software"], k=rng.randint(0, 9)), *w, *phrase.split()[: rng.randint(0, 5)]]))
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows_of(got, "doc_id", "labels", "score") == sorted(((i, *brute_labels(t)) for i, t in enumerate(texts)), key=str)
    assert all("mit-grant" in brute_labels(t)[0] for t in texts[:3])


def test_op10(spark):
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, SF, "documents").collect()]
    got = rows_of(queries.op10_license_scan(spark, SF), "doc_id", *BASE_COLUMNS, "labels", "score")
    assert got == sorted(((d, *brute_base(t), *brute_labels(t)) for d, t in rows), key=str)
