"""Rows of a frame under a number of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beatwatch.session import shared_dir


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """A copy of ``docs`` in the shared folder with a number for each row, and the name of that column.

    The copy is written once, so the numbers are the same in every later step, also after an executor is lost. The
    name is one that ``docs`` does not have.
    """
    name = "_row"
    while name.lower() in [c.lower() for c in docs.columns]:
        name += "_"
    where = shared_dir(docs.sparkSession, "rows")
    docs.withColumn(name, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(where)
    return docs.sparkSession.read.parquet(where), name
