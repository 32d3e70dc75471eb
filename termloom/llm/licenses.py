"""Licence scan by diagonal voting, with DataFrame functions only.

All rolling 2-word hashes of a document are joined with the places of the same
hashes in licence templates. A match votes for the diagonal (place in the document
minus place in the template). A short phrase stands where its diagonal has all
votes. For a long template, neighbouring diagonals are merged into bands: all
``drift`` + 1 diagonals from one on, and one more for each 8 grams. Words put in or
left out move the later votes to a neighbouring diagonal, so they do no harm, and
votes that stand between by chance are on diagonals far off. A band is a span of at
most the template's length and its drift; the span counts if the template places
that voted cover ``min_cover`` of the template. The words of every vote are compared,
not only hashes.

The template table is a constant of this module, a few hundred rows, and so is
broadcast. Hashes that no template has are dropped inside the row, before the join:
a document emits a row for each match and one end marker, with two words each, so
the cost of a text is linear in its length. A template table of over ``sieve_rows``
rows, which a caller may pass, is not looked at inside the row but joined as it is.

Votes are gathered by (id, hash of the text, input partition), which stays the same
when a lost task runs again; rows that repeat are counted by their end markers.

Defined cases: null and empty texts have no words and no labels; overlapping
places all count; rows that repeat are each reported; very long texts are scanned
whole; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import common

# The phrases that are counted, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Longer licence wordings, and the labels they add.
LONGER = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license": "apache-2.0",
    "licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
}
GRAM = 2
#: A template's places are kept as bits of a 64-bit number.
MOST_GRAMS = 62
DRIFT, COVER = 3, 0.8
KEY = ("doc_id", "text_hash", "part")


def places(base: dict[str, str] = BASE, longer: dict[str, str] = LONGER) -> list[tuple]:
    """(template, label, is_base, n_grams, t, w1, w2) of each gram of each template."""
    rows = []
    for is_base, phrases in ((True, base), (False, longer)):
        for phrase, label in phrases.items():
            w = re.findall(common.WORD, phrase)
            if not GRAM <= len(w) < MOST_GRAMS + GRAM:
                raise ValueError(f"a template needs {GRAM} to {MOST_GRAMS + GRAM - 1} words: {phrase}")
            rows += [(phrase, label, is_base, len(w) - 1, t, w[t], w[t + 1]) for t in range(len(w) - 1)]
    return rows


def templates(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    df = spark.createDataFrame(rows, "template string, label string, is_base boolean, n_grams int, t int, w1 string, w2 string")
    return df.withColumn("hash", F.xxhash64("w1", "w2"))


def votes(documents: DataFrame, table: DataFrame, sieve: list[int] | None) -> DataFrame:
    """(KEY, n_words, p, t, template, label, is_base, n_grams): each vote, and for each row of ``documents`` one row without a place."""
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.spark_partition_id().alias("part"), common.words_of(text).alias("words"))

    def found(w):  # noqa: ANN001, ANN202
        grams = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.struct(i.alias("p"), F.xxhash64(x, F.get(w, i + 1)).alias("hash")))
        grams = grams if sieve is None else F.filter(grams, lambda g: g["hash"].isin(sieve))
        spelled = F.transform(grams, lambda g: F.struct(g["p"].alias("p"), g["hash"].alias("hash"), F.get(w, g["p"]).alias("d1"), F.get(w, g["p"] + 1).alias("d2")))
        end = F.struct(F.lit(None).cast("int").alias("p"), F.lit(None).cast("long").alias("hash"), F.lit(None).cast("string").alias("d1"), F.lit(None).cast("string").alias("d2"))
        return F.struct(F.size(w).alias("n_words"), F.concat(F.array(end), spelled).alias("grams"))

    rows = docs.select(*KEY, common.let(F.col("words"), found).alias("f")).select(*KEY, F.col("f.n_words").alias("n_words"), F.col("f.grams").alias("grams"))
    # outer, though no row is empty: else Spark puts a filter before it that computes the array once more
    placed = rows.select(*KEY, "n_words", F.inline_outer("grams"))
    matched = placed.join(F.broadcast(table), (placed["hash"] == table["hash"]) & (placed["d1"] == table["w1"]) & (placed["d2"] == table["w2"]), "left")
    return matched.where(F.col("p").isNull() | F.col("t").isNotNull()).select(*KEY, "n_words", "p", "t", "template", "label", "is_base", "n_grams")


def spans(voted: DataFrame, *, drift: int = DRIFT, min_cover: float = COVER) -> DataFrame:
    """(KEY, n_words, copies, label, is_base, start, cover): verified spans, and one row without a label for each KEY, which says how many rows it has."""
    bit = F.expr("shiftleft(1L, t)")
    per = voted.repartition(*KEY).groupBy(*KEY, "n_words", "template", "label", "is_base", "n_grams", (F.col("p") - F.col("t")).alias("diagonal"))
    per = per.agg(F.bit_or(bit).alias("places"), F.count("*").alias("copies"))
    wide = F.when(F.col("is_base") | F.col("template").isNull(), F.lit(0)).otherwise(drift + F.floor(F.col("n_grams") / 8).cast("int"))
    bands = per.withColumn("band", F.explode(F.sequence(F.coalesce("diagonal", F.lit(0)) - wide, F.coalesce("diagonal", F.lit(0)))))
    merged = bands.groupBy(*KEY, "n_words", "template", "label", "is_base", "n_grams", "band").agg(F.bit_or("places").alias("places"), F.max("copies").alias("copies"))
    cover = F.bit_count("places") / F.col("n_grams")
    whole = F.col("template").isNull() | (cover >= F.when(F.col("is_base"), 1.0).otherwise(min_cover))
    return merged.withColumn("cover", cover).where(whole).select(*KEY, "n_words", "copies", "label", "is_base", F.col("band").alias("start"), "cover")


def scan(documents: DataFrame, base: dict[str, str] = BASE, longer: dict[str, str] = LONGER, *, sieve_rows: int = 2000, **how) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each document."""
    rows = places(base, longer)
    table = templates(documents.sparkSession, rows)
    sieve = [r["hash"] for r in table.select("hash").distinct().collect()] if len(rows) <= sieve_rows else None
    found = spans(votes(documents, table, sieve), **how)
    is_base, real = F.col("is_base"), F.col("label").isNotNull()
    joined = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(c)))
    per = found.groupBy(*KEY).agg(
        F.max("n_words").cast("long").alias("n_words"), F.count_if(is_base).alias("n_base"), F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(is_base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.coalesce(F.max(F.when(real, F.col("cover"))), F.lit(0.0)).alias("score"), F.max(F.when(~real, F.col("copies"))).alias("copies"),
    )
    return common.each_copy(per, "copies").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
