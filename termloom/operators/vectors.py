"""Document vectors: exact cosine neighbours, and a trained word-vector stand-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_to(vectors: DataFrame, vec_id: int | None = None, k: int = 1, *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, distance): the ``k`` nearest others of one vector (the one with the smallest id, if none is named).

    The one query vector is a literal in the plan; each task keeps its own k best.
    """
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("v"))
    chosen = rows.where(F.col("vec_id") == vec_id) if vec_id is not None else rows.orderBy("vec_id")
    found = chosen.limit(1).collect()
    if not found:
        return rows.select("vec_id", F.lit(None).cast("double").alias("distance")).limit(0)
    query = F.lit([float(x) for x in found[0]["v"]]).cast("array<double>")
    distance = F.round(cosine_distance(F.col("v"), query), 6)
    return rows.where(F.col("vec_id") != found[0]["vec_id"]).select("vec_id", distance.alias("distance")).orderBy("distance", "vec_id").limit(k)


def train_word_vectors(texts: DataFrame, *, size: int = 100, min_count: int = 3, passes: int = 5, partitions: int = 5, seed: int = 1):
    """A Word2Vec model; a document's vector is the mean of its words' vectors. Save and load it with ``write()`` and ``load()``."""
    from pyspark.ml.feature import Word2Vec

    from termloom.functions.analysis import vector_tokens

    tokens = texts.select(vector_tokens(F.col("text")).alias("tokens"))
    return Word2Vec(vectorSize=size, minCount=min_count, maxIter=passes, numPartitions=partitions, seed=seed, inputCol="tokens", outputCol="vector").fit(tokens)


def infer(model, texts: DataFrame) -> DataFrame:
    """``texts`` with a ``vector`` of doubles."""
    from pyspark.ml.functions import vector_to_array

    from termloom.functions.analysis import vector_tokens

    return model.transform(texts.withColumn("tokens", vector_tokens(F.col("text")))).withColumn("vector", vector_to_array("vector")).drop("tokens")
