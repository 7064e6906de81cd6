"""The nightly batch job: five CSV datasets in, nine result tables out."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from beatwatch.operators.correlate import correlations
from beatwatch.operators.hotspots import hotspots
from beatwatch.operators.offenders import offender_density, offender_flags
from beatwatch.operators.rates import arrest_rates, top_arrest_rates
from beatwatch.operators.trends import crime_trends
from beatwatch.operators.violence import top_communities, violence_analysis
from beatwatch.session import build_session, shared_dir
from beatwatch.sinks.tables import overwrite_table
from beatwatch.sources.csv_files import find_csv, land_counted, project, split_corrupt

# The part of each dataset's file name that identifies it, in each of its spellings.
FILE_KEYWORDS: dict[str, str | tuple[str, ...]] = {
    "crimes": "rimes",
    "arrests": "rrests",
    "violence": "iolence",
    "sex-offenders": ("ex_Off", "ex Off"),
    "police-stations": "tations",
}


def load_raw(
    spark: SparkSession, data_dir: str, landing: str | None = None, partitions: int | None = None
) -> tuple[dict[str, DataFrame], dict[str, dict[str, int]]]:
    """The well-formed rows of the five datasets, and how many rows were read and malformed in each.

    Each CSV is parsed once into Parquet, in ``partitions`` files if given, so that no table parses it again.
    Malformed rows stay in the landed table.
    """
    landing = landing or shared_dir(spark, "landing")
    rows, counts = {}, {}
    for dataset, word in FILE_KEYWORDS.items():
        raw = project(find_csv(spark, data_dir, word, dataset, keep_corrupt=True), dataset)
        landed, counts[dataset] = land_counted(raw, f"{landing}/{dataset}", partitions)
        rows[dataset], _ = split_corrupt(landed)
    return rows, counts


def result_tables(raw: dict[str, DataFrame], k: int = 10, min_crimes: int = 100) -> dict[str, DataFrame]:
    """The nine tables as lazy frames."""
    crimes, arrests, violence = raw["crimes"], raw["arrests"], raw["violence"]
    flagged = offender_flags(raw["sex-offenders"])
    return {
        "crime_trends": crime_trends(crimes),
        "arrest_rate_analysis": arrest_rates(crimes, arrests),
        "top_arrest_rate_crime_types": top_arrest_rates(crimes, min_crimes),
        "violence_analysis": violence_analysis(violence),
        "top_violence_community": top_communities(violence),
        "sex_offender_proximity": flagged,
        "district_offender_density": offender_density(raw["police-stations"], flagged),
        "hotspots": hotspots(crimes, k),
        "correlations": correlations(crimes, violence, raw["sex-offenders"]),
    }


def run(spark: SparkSession, data_dir: str, out: str, k: int = 10, min_crimes: int = 100, jdbc: dict[str, str] | None = None, partitions: int | None = None) -> list[str]:
    """Write every table, and the dead letters and row counts of each dataset; returns the tables' names."""
    landing = f"{out.rstrip('/')}/landing"
    raw, counts = load_raw(spark, data_dir, landing, partitions)
    for dataset in FILE_KEYWORDS:
        _, bad = split_corrupt(spark.read.parquet(f"{landing}/{dataset}"))
        bad.write.mode("overwrite").parquet(f"{out.rstrip('/')}/malformed/{dataset}")
    read = [(name, c["read"], c["malformed"]) for name, c in counts.items()]
    spark.createDataFrame(read, "dataset string, read long, malformed long").coalesce(1).write.mode("overwrite").parquet(f"{out.rstrip('/')}/row_counts")
    tables = result_tables(raw, k, min_crimes)
    for name, df in tables.items():
        overwrite_table(df, out, name, jdbc)
    return list(tables)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("data_dir")
    args.add_argument("out")
    args.add_argument("--clusters", type=int, default=10)
    args.add_argument("--min-crimes", type=int, default=100)
    args.add_argument("--landing-partitions", type=int)
    args.add_argument("--jdbc", nargs="*", default=[], metavar="OPTION=VALUE", help="also write the tables over JDBC, with these writer options")
    given = args.parse_args()
    spark = build_session("beatwatch-batch")
    run(spark, given.data_dir, given.out, given.clusters, given.min_crimes, dict(o.split("=", 1) for o in given.jdbc) or None, given.landing_partitions)


if __name__ == "__main__":
    main()
