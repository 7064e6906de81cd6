"""K-Means hotspots over coordinates."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from beatwatch.operators.enrich import with_coordinates


# how far a centre may still move, in degrees, when a fit ends
TOLERANCE = 1e-4


def fit_hotspots(
    points: DataFrame,
    k: int = 10,
    seed: int = 42,
    max_iter: int = 30,
    init: str = "random",
    lat: str = "latitude",
    lon: str = "longitude",
) -> KMeansModel:
    """Cluster the coordinate columns. Training passes are distributed; only the k centres return."""
    features = VectorAssembler(inputCols=[lat, lon], outputCol="features")
    vectors = features.transform(points.select(lat, lon)).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        means = KMeans(featuresCol="features", predictionCol="cluster_id", k=k, seed=seed, maxIter=max_iter, initMode=init, tol=TOLERANCE)
        return means.fit(vectors)
    finally:
        vectors.unpersist()


def assign_clusters(points: DataFrame, model: KMeansModel, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    vectors = VectorAssembler(inputCols=[lat, lon], outputCol="features").transform(points)
    return model.transform(vectors).drop("features")


def centroid_table(points: DataFrame, model: KMeansModel) -> DataFrame:
    rows = [(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())]
    return points.sparkSession.createDataFrame(rows, "cluster_id int, centroid_lat double, centroid_lon double")


def cluster_stats(clustered: DataFrame, kind: str = "primary_type", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Size, mean position and the distinct types of each cluster."""
    return clustered.groupBy("cluster_id").agg(
        F.count("*").alias("crime_count"),
        F.round(F.avg(lat), 6).alias("avg_lat"),
        F.round(F.avg(lon), 6).alias("avg_lon"),
        F.array_join(F.array_sort(F.collect_set(kind)), ", ").alias("primary_types"),
    )


def with_centroids(stats: DataFrame, centroids: DataFrame) -> DataFrame:
    """Inner join on cluster_id; the engine broadcasts a side that is small enough."""
    return stats.join(centroids, "cluster_id")


def hotspots(crimes: DataFrame, k: int = 10, **options) -> DataFrame:
    points = with_coordinates(crimes.select("primary_type", "latitude", "longitude"))
    model = fit_hotspots(points, k, **options)
    return with_centroids(cluster_stats(assign_clusters(points, model)), centroid_table(points, model))


def ranked_hotspots(table: DataFrame) -> DataFrame:
    """Largest first, a null type list as ''."""
    return table.withColumn("primary_types", F.coalesce("primary_types", F.lit(""))).orderBy(
        F.desc("crime_count"), F.asc("cluster_id")
    )
