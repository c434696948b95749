"""Clusters of vectors by named other methods, and vectors of given models."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bisecting(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, cluster) by bisecting k-means on cosine: the form for any size."""
    data = vectors.select("vec_id", array_to_vector(F.col("prompt_vector").cast("array<double>")).alias("features"))
    model = BisectingKMeans(k=k, seed=1, distanceMeasure="cosine", featuresCol="features").fit(data)
    return model.transform(data).select("vec_id", F.col("prediction").alias("cluster"))


def embedded(texts: DataFrame, model, column: str = "text", size: int = 64) -> DataFrame:
    """Adds `vector` by a given model: a function that returns, once per worker, one from texts to a matrix."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for texts_ in batches:
            yield pd.Series(list(encode(texts_.fillna("").tolist())))

    return texts.withColumn("vector", F.pandas_udf(run, "array<float>")(F.col(column)))
