"""Finding nodes by name token, substring or embedding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.weights import name_tokens


def token_index(names: DataFrame, name: str = "name") -> DataFrame:
    """(token, name): an inverted index of distinct name tokens."""
    return names.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct().select(F.explode(F.array_distinct(name_tokens("name"))).alias("token"), "name")


def match_tokens(index: DataFrame, tokens: Sequence[str], limit: int = 16) -> DataFrame:
    """Names with a token that begins with one of ``tokens``, in name order; tokens under two bytes match nothing."""
    wanted = [t.lower() for t in tokens if len(t.encode()) >= 2]
    test = F.lit(False)
    for t in wanted:
        test = test | F.col("token").startswith(t)
    return index.where(test).select("name").distinct().orderBy("name").limit(limit)


def match_substring(names: DataFrame, parts: Sequence[str], limit: int = 16) -> DataFrame:
    test = F.lit(False)
    for p in parts:
        test = test | F.lower("name").contains(p.lower())
    return names.where(test).select("name").distinct().orderBy("name").limit(limit)


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def match_vector(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score): the ``k`` rows most like ``query`` by cosine, ties by key. Vectors of another length,
    null, zero or with a value that is no number are left out. Brute force, one pass, all in the JVM."""
    query = [float(x) for x in query]
    if not query or len(query) > 4096 or not any(query):
        raise ValueError("a query vector needs 1 to 4096 numbers, not all zero")
    q = F.array(*[F.lit(x) for x in query])
    norm = sum(x * x for x in query) ** 0.5
    fit = F.size(vector) == len(query)
    rows = vectors.where(fit).withColumn("_n", F.sqrt(dot(vector, vector))).where("_n > 0 AND NOT isnan(_n) AND _n < double('Infinity')")
    score = dot(vector, q) / (F.col("_n") * F.lit(norm))
    return rows.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)
