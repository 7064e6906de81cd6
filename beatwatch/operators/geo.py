"""District centroids and the lookup onto them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatwatch.functions.text import district_key

# Approximate centre of each police district (latitude, longitude).
DISTRICT_CENTROIDS = {
    "001": (41.8827, -87.6278),
    "002": (41.68, -87.6195),
    "003": (41.7726, -87.5822),
    "004": (41.7067, -87.6099),
    "005": (41.7395, -87.5565),
    "006": (41.7598, -87.6487),
    "007": (41.766, -87.706),
    "008": (41.8001, -87.7388),
    "009": (41.8218, -87.6981),
    "010": (41.8554, -87.7272),
    "011": (41.8669, -87.7177),
    "012": (41.8699, -87.668),
    "014": (41.9124, -87.673),
    "015": (41.8749, -87.7494),
    "016": (41.9519, -87.7629),
    "017": (41.994, -87.6952),
    "018": (41.9036, -87.634),
    "019": (41.9477, -87.6528),
    "020": (41.9755, -87.674),
    "022": (41.7358, -87.6816),
    "024": (41.996, -87.736),
    "025": (41.9055, -87.7567),
}


def centroid_dimension(spark: SparkSession) -> DataFrame:
    rows = [(k, lat, lon) for k, (lat, lon) in DISTRICT_CENTROIDS.items()]
    return spark.createDataFrame(rows, "district_key string, centre_lat double, centre_lon double")


def locate_districts(df: DataFrame, district: str = "district") -> DataFrame:
    """Attach the centre of each row's district; rows of unknown districts are left out.

    The dimension is the fixed table above, so it is broadcast.
    """
    centres = centroid_dimension(df.sparkSession)
    return df.withColumn("district_key", district_key(district)).join(F.broadcast(centres), "district_key")
