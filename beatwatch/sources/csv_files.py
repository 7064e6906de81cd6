"""The five CSV datasets: finding, reading, classifying, splitting off malformed rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwatch.functions.text import null_if_empty
from beatwatch.schemas import RAW_COLUMNS, STREAMED_DATASETS, raw_schema
from beatwatch.sources.csv_records import CORRUPT, read_records

# File-name rules in the order they apply.
FILE_RULES = (
    ("violence", ("violence",)),
    ("crimes", ("crimes",)),
    ("arrests", ("arrests",)),
    ("sex-offenders", ("sex_offenders", "sex offenders")),
    ("police-stations", ("police_stations", "police stations")),
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool = False) -> DataFrame:
    """The columns of ``schema`` by name from all-text CSV with header, multi-line quoted fields and doubled quotes.

    Columns may stand in any order and among others; a missing one is an error. Every file goes by its own
    header. An empty field is null, quoted or not. Large files are cut over many tasks wherever records end (see
    ``csv_records``); rows come in no order. The files are read once, when this is called.
    With ``keep_corrupt`` rows with a wrong number of fields carry their text in ``_corrupt_record``.
    """
    rows = read_records(spark, path, schema.fieldNames(), keep_corrupt)
    if rows is None:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]) if keep_corrupt else schema)
    return rows


def any_case_glob(keyword: str) -> str:
    """'rimes' -> '*[rR][iI][mM][eE][sS]*.csv'."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else f"[{c}]" for c in keyword) + "*.csv"


def find_csv(spark: SparkSession, folder: str, keyword: str | tuple[str, ...], dataset: str, keep_corrupt: bool = False) -> DataFrame:
    """Read every CSV file (or folder of CSV parts) in ``folder`` whose name contains ``keyword``, or one of
    several, in any case and ends in .csv; none is an error."""
    words = (keyword,) if isinstance(keyword, str) else keyword
    try:
        return read_csv(spark, f"{folder.rstrip('/')}/{{{','.join(map(any_case_glob, words))}}}", raw_schema(dataset), keep_corrupt)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no CSV matching {keyword!r} in {folder}") from error


def classify(file_name: Column) -> Column:
    """Dataset of a file by the first rule its lower-cased name meets, else 'unknown'."""
    name = F.lower(file_name)
    chain = F
    for dataset, words in FILE_RULES:
        hit = F.contains(name, F.lit(words[0]))
        for word in words[1:]:
            hit = hit | F.contains(name, F.lit(word))
        chain = chain.when(hit, F.lit(dataset))
    return chain.otherwise(F.lit("unknown"))


def streamed_only(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Rows of the datasets that feed the event stream; reference data and unknown files stay out."""
    return df.filter(F.col(dataset).isin(*STREAMED_DATASETS))


def project(df: DataFrame, dataset: str) -> DataFrame:
    """Snake-case columns of a dataset, empty text as null; a corrupt-record column is kept."""
    columns = [null_if_empty(F.col(f"`{header}`")).alias(name) for header, name in RAW_COLUMNS[dataset].items()]
    return df.select(*columns, *([CORRUPT] if CORRUPT in df.columns else []))


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well-formed rows, quarantined rows with their text) of a landed dataset."""
    good = df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.filter(F.col(CORRUPT).isNotNull()).select(
        F.col(CORRUPT).alias("record"), F.lit("wrong_field_count").alias("reason")
    )
    return good, bad


def land(df: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Write once as Parquet, spread over ``partitions`` tasks, and read it back."""
    (df.repartition(partitions) if partitions else df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def land_counted(df: DataFrame, path: str, partitions: int | None = None) -> tuple[DataFrame, dict[str, int]]:
    """``land`` with the number of rows read and of malformed rows, counted while they are written."""
    seen = Observation()
    bad = F.count_if(F.col(CORRUPT).isNotNull())
    landed = land(df.observe(seen, F.count(F.lit(1)).alias("read"), bad.alias("malformed")), path, partitions)
    return landed, seen.get
