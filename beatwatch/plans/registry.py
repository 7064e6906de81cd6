"""Registry of the queries that run on the given tables, each with its SQL check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatwatch.plans.shapes import shape, shape_sql
from beatwatch.session import configure, shared_dir


class Tables:
    """The given tables, raw or shaped as a public-safety dataset."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def shaped(self, name: str) -> DataFrame:
        return shape(self.spark, self.sf_dir, name)

    crimes = property(lambda self: self.shaped("crimes"))
    arrests = property(lambda self: self.shaped("arrests"))
    violence = property(lambda self: self.shaped("violence"))
    offenders = property(lambda self: self.shaped("offenders"))
    stations = property(lambda self: self.shaped("stations"))
    points = property(lambda self: self.shaped("points"))
    gold = property(lambda self: self.shaped("gold"))

    @property
    def raw_sets(self) -> dict[str, DataFrame]:
        return {
            "violence": self.violence,
            "crimes": self.crimes,
            "arrests": self.arrests,
            "sex-offenders": self.offenders,
        }

    def work_dir(self, label: str) -> str:
        return shared_dir(self.spark, label)


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(self.build(Tables(configure(spark), sf_dir)))


ENTRIES: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, shapes: str = "") -> Callable:
    """Register a query; ``sql`` is its check and may use the shapes named in ``shapes``."""

    def wrap(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        text = sql
        if sql is not None and shapes:
            head = shape_sql(*shapes.split())
            text = f"{head}, {sql.strip()[5:]}" if sql.strip().startswith("WITH ") else f"{head}\n{sql}"
        ENTRIES[name] = Entry(build, text)
        return build

    return wrap


def portable(df: DataFrame) -> DataFrame:
    """Times without zone, so any SQL engine compares them the same way."""
    zoned = {n for n, t in df.dtypes if t == "timestamp"}
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in zoned else F.col(c) for c in df.columns]) if zoned else df
