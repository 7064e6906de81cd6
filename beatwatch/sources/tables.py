"""Scans of the stored result tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from beatwatch.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan a result table; one that was never written reads as empty with its contract's columns."""
    try:
        return spark.read.parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], TABLES[name])
