"""Compaction of the tables that the stream application keeps adding versions to."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from beatwatch.session import build_session
from beatwatch.sinks.tables import compact_versions
from beatwatch.streaming.batches import ANOMALY_KEYS

# Tables of the stream application in update or complete mode, with their keys.
VERSIONED = {
    "metrics": ["window_start", "window_end", "district"],
    "counters": ["severity", "dataset"],
    "active": ["pane_start"],
    **{f"{kind}_alerts": keys for kind, keys in ANOMALY_KEYS.items()},
}


def run(spark: SparkSession, out: str) -> None:
    for name, keys in VERSIONED.items():
        compact_versions(spark, f"{out.rstrip('/')}/{name}", keys)


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("out", help="the table folder of the stream application")
    run(build_session("beatwatch-compact"), args.parse_args().out)


if __name__ == "__main__":
    main()
