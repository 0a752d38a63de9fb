"""Clusters and shape of a set of vectors, by pyspark.ml: topics, diversity samples, principal components."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import analyze, vector


def k_means(vectors: DataFrame, k: int = 16, seed: int = 42) -> DataFrame:
    """(id, cluster, confidence) of (id, vector), on vectors of length 1; k is at most the number of vectors.

    Confidence is 1 / (1 + distance to the centre), from 0.1 to 1.  Centres are k rows.
    """
    n = vectors.count()
    if not n:
        return vectors.select("id", F.lit(0).alias("cluster"), F.lit(0.0).alias("confidence")).limit(0)
    rows = vectors.select("id", vector.unit(F.transform("vector", lambda x: x.cast("double"))).alias("u"))
    model = KMeans(k=max(2, min(k, n)), seed=seed, featuresCol="features", predictionCol="cluster").fit(rows.withColumn("features", array_to_vector("u")))
    found = model.transform(rows.withColumn("features", array_to_vector("u")))
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    gap = F.zip_with("u", F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b))
    distance = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x))
    return found.select("id", "cluster", F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1 / (1 + distance))).alias("confidence"))


def discover_topics(chunks: DataFrame, k: int = 16, terms: int = 15) -> DataFrame:
    """(cluster, term, score, rank) for chunks (id, text, vector): what sets each cluster's words apart."""
    return analyze.cluster_terms(chunks.join(k_means(chunks.select("id", "vector"), k), "id").select("id", "cluster", "text"), terms)


def diverse_sample(vectors: DataFrame, size: int, k: int = 8, seed: int = 42) -> DataFrame:
    """(id) of ``size`` rows spread over clusters: as many from each as go in evenly, and the rest by hash; all if there are no more."""
    if vectors.count() <= size:
        return vectors.select("id")
    chance: Column = F.xxhash64(F.lit(seed), "id")
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(chance, "id"))
    even = F.when(place <= max(1, size // k), 0).otherwise(1)
    return k_means(vectors, k, seed).withColumn("turn", even).orderBy("turn", chance, "id").limit(size).select("id")


def spectrum(vectors: DataFrame, most: int = 256) -> DataFrame:
    """One row: dimensions, components for 90, 95 and 99 % of the variance, and the participation ratio."""
    dims = len(vectors.first()["vector"])
    rows = vectors.select(array_to_vector(F.transform("vector", lambda x: x.cast("double"))).alias("features"))
    shares = [float(x) for x in PCA(k=min(most, dims), inputCol="features", outputCol="p").fit(rows).explainedVariance]
    total, need = 0.0, {}
    for k, share in enumerate(shares, 1):
        total += share
        for level in (0.90, 0.95, 0.99):
            if total >= level - 1e-12:
                need.setdefault(level, k)
    ratio = sum(shares) ** 2 / sum(x * x for x in shares)
    row = (dims, *[need.get(level, dims) for level in (0.90, 0.95, 0.99)], round(ratio, 2))
    return vectors.sparkSession.createDataFrame([row], "dims int, dims_90 int, dims_95 int, dims_99 int, participation double")


def centre_of(vectors: DataFrame) -> DataFrame:
    """(place, mean): the mean vector, one row per dimension."""
    return vectors.select(F.posexplode("vector").alias("place", "x")).groupBy("place").agg(F.avg("x").alias("mean"))


__all__ = ["centre_of", "discover_topics", "diverse_sample", "k_means", "spectrum"]
