"""Learned parts: word vectors, clusters, hashed text vectors, the pluggable answer hook."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def word_vectors(docs: DataFrame, words: str, size: int = 100, window: int = 5, seed: int = 42):
    """Skip-gram model over arrays of words."""
    from pyspark.ml.feature import Word2Vec

    return Word2Vec(vectorSize=size, windowSize=window, minCount=1, seed=seed, inputCol=words, outputCol="vector").fit(docs)


def clusters(vectors: DataFrame, vec: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = vectors.withColumn("_f", array_to_vector(F.col(vec).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster").fit(d).transform(d).drop("_f")


def hashed_vectors(docs: DataFrame, key: str, text: str, dims: int = 64) -> DataFrame:
    """(key, bucket, n): counts of a text's words in ``dims`` hash buckets, the buckets that are not empty: a vector in its sparse form."""
    words = docs.select(key, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}]+")).alias("w")).where("w <> ''")
    bucket = F.conv(F.substring(F.md5("w"), 1, 7), 16, 10).cast("bigint") % dims
    return words.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def entities(docs: DataFrame, text: str, least: int = 2, stop: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``entities``: distinct dotted, dashed or numbered names in a text; letters outside ASCII beside a name are no part of it."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9]*(?:[._-][A-Za-z0-9]+)+)(?![A-Za-z0-9_])"), F.lit(1)))
    return docs.withColumn("entities", F.filter(found, lambda x: (F.length(x) >= least) & ~x.isin(*stop) if stop else F.length(x) >= least))


def answers(docs: DataFrame, prompt: str, answer: Callable[[str], str] | None = None) -> DataFrame:
    """Adds ``answer`` by a function of the prompt; without one, a fixed stub.  Rows without prompt or answer are dropped."""
    fn = answer or (lambda p: f"Root Cause: undetermined ({len(p)} characters)")

    @F.pandas_udf(T.StringType())
    def ask(s: pd.Series) -> pd.Series:
        return s.map(lambda p: fn(p) if p else None)

    return docs.where(F.length(prompt) > 0).withColumn("answer", ask(prompt)).where("answer is not null")
