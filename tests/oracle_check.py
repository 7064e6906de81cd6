"""Compare registered queries with their SQL check in DuckDB, value by value.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
KINDS = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.12g}"
    return str(value) if value is not None and not isinstance(value, (bool, int, str)) else value


def _rows(rows, order: list[int]) -> Counter:
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, build, sql: str | None) -> str:
    """Empty when they agree, else what differs."""
    df = build(spark, sf_dir)
    ours = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if ours else "no rows"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    theirs = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    wrong = [(c, k, kinds[c]) for c, k in df.dtypes if KINDS.get(k, k) != kinds[c] and kinds[c] not in ("STRING",)]
    if wrong:
        types = {str(r) for r in wrong}
        kinds_differ = f"types {types}"
    else:
        kinds_differ = ""
    shared = sorted(names)
    a = _rows(ours, [df.columns.index(c) for c in shared])
    b = _rows(theirs, [names.index(c) for c in shared])
    if a != b:
        return (
            f"rows {sum(a.values())} vs {sum(b.values())}; columns {shared}\n   only ours {list((a - b).items())[:3]}"
            f"\n   only sql  {list((b - a).items())[:3]} {kinds_differ}"
        )
    if not ours:
        return "both empty"
    return kinds_differ


def main() -> int:
    import __spark_entry__ as entry
    from beatwatch.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    checks, sql = entry.queries(), entry.oracle_sql()
    spark = build_session("check", "local[8]", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name in args or checks:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, checks[name], sql.get(name))
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        failed += bool(problem)
        kind = "sql" if name in sql else "rows only"
        print(f"{'FAIL' if problem else 'ok':4} {name} ({kind}) {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{failed} failed of {len(args or checks)}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
