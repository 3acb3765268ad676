"""Centroids, nearest-centroid labels, clusters and coverage."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import draw
from skein.functions.vectors import dot, unit


def centroids(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centroid): the unit mean vector per label, by partial sums per place of the vector."""
    flat = rows.where(F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vector).alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))
    return whole.withColumn("centroid", unit(F.col("centroid")))


def nearest(rows: DataFrame, cents: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, label, conf, margin): the label of the centroid with the largest dot product, and its lead over the second.

    ``cents`` is a taxonomy's worth of rows and goes along as one array, so that rows are only mapped. Ties go to
    the larger label. With one centroid the margin is its product.
    """
    # One row per label: a taxonomy, bounded by its own size.
    listed = cents.agg(F.collect_list(F.struct("label", "centroid")).alias("cents"))
    sims = F.transform("cents", lambda c: F.struct(F.round(dot(F.col(vector), c["centroid"]), 9).alias("sim"), c["label"].alias("label")))
    ranked = rows.join(F.broadcast(listed)).select(key, F.reverse(F.array_sort(sims)).alias("s"))
    return ranked.select(key, F.col("s")[0]["label"].alias("label"), F.col("s")[0]["sim"].alias("conf"), (F.col("s")[0]["sim"] - F.coalesce(F.try_element_at("s", F.lit(2))["sim"], F.lit(0.0))).alias("margin"))


def kmeans(rows: DataFrame, k: int, seed: int = 42, vector: str = "embedding", starts: int = 1) -> DataFrame:
    """Adds ``cluster``: Spark ML's k-means (k-means|| start), the best of several starts by its cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = rows.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    kept = ready.select("features").persist()  # read once for all starts and rounds
    with ThreadPoolExecutor(4) as pool:  # the starts are independent, and each is many small jobs
        models = list(pool.map(lambda i: KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="cluster").fit(kept), range(starts)))
    model = min(models, key=lambda m: m.summary.trainingCost)
    kept.unpersist()
    return model.transform(ready).drop("features")


def exemplars(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per group, the first in hash order of the key."""
    order = Window.partitionBy(group).orderBy(draw(seed, F.col(key)), key)
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def map_clusters(rows: DataFrame, taxonomy: DataFrame, cluster: str = "cluster", default: str = "out_of_scope") -> DataFrame:
    """Adds ``intent``: the taxonomy's name for a cluster (the first by name, if several), or the default."""
    names = taxonomy.select("name", F.explode("source_clusters").alias(cluster)).groupBy(cluster).agg(F.min("name").alias("intent"))
    return rows.join(names, cluster, "left").withColumn("intent", F.coalesce("intent", F.lit(default)))


def coverage(rows: DataFrame, default: str = "out_of_scope") -> DataFrame:
    """One row (total, mapped, coverage)."""
    mapped = F.count_if(F.col("intent") != default)
    return rows.agg(F.count("*").alias("total"), mapped.alias("mapped"), F.coalesce(F.try_divide(mapped, F.count("*")), F.lit(0.0)).alias("coverage"))
