"""Records of multi-line CSV files that many tasks read.

A file is cut into splits wherever the file system likes, also inside a quoted field. Every line is read once and knows
what it does to the state "inside quotes": it keeps it, turns it round, or sets it whatever it was. These steps are
put together along the lines of each split, then along the splits of each file, so the state at every line is
known without reading a file from its start. Lines that lie wholly outside of quotes are records; only the others are
gathered, by the line that their record begins with.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from beatwatch.session import shared_dir

CORRUPT = "_corrupt_record"
_QUOTE = '"'
# states within a line: outside of quotes, inside, and at a quote that ends the field unless another follows
_OUT, _IN, _END = 0, 1, 2


def _after(value: Column, inside: bool) -> Column:
    """Whether the end of the line lies inside quotes, if its start does or does not.

    A quote opens a field only at the field's start. Within quotes a doubled quote is text; a single one ends the
    quoted part, and what follows up to the comma is taken as it stands. These are the parser's rules.
    """
    pieces = F.split(value, _QUOTE)
    opens = lambda piece, first: F.when(piece.endswith(",") | (first & (piece == "")), _IN).otherwise(_OUT)

    def step(seen: Column, piece: Column) -> Column:
        state, first = seen["state"], seen["first"]
        new = F.when(state == _IN, _END).when((state == _END) & (piece == ""), _IN).otherwise(opens(piece, first))
        return F.struct(new.alias("state"), F.lit(False).alias("first"))

    start = F.struct(F.lit(_IN if inside else _OUT).alias("state"), F.lit(not inside).alias("first"))
    # every piece but the last is followed by a quote
    before_quotes = F.slice(pieces, 1, F.size(pieces) - 1)
    walked = F.aggregate(before_quotes, start, step, lambda seen: seen["state"] == _IN)
    return F.when(value.contains(_QUOTE), walked).otherwise(F.lit(inside))


def write_lines(spark: SparkSession, path: str, where: str) -> DataFrame:
    """The lines of all files under ``path``, written once to ``where`` with their place and their step.

    ``block`` is where the line's split begins in its file, ``place`` ascends within a split. Later reads use this table, so
    splits that another reading of the files would cut elsewhere do no harm.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
        _after(F.col("value"), False).alias("from_out"),
        _after(F.col("value"), True).alias("from_in"),
        F.col("value").isin("", "\r").alias("blank"),
    )
    lines.write.parquet(where)
    return spark.read.parquet(where)


def _composed(rows: DataFrame, w: Window, fixed: Column, flips: Column) -> DataFrame:
    """Steps put together from the window's start to each row: ``fixed`` (null: as it was at the start), ``flips``."""
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_turns", F.sum(flips).over(run))
    rows = rows.withColumn("_set", F.last(F.when(fixed.isNotNull(), F.struct(fixed.alias("to"), F.col("_turns").alias("turns"))), True).over(run))
    turned = (F.col("_turns") - F.coalesce(F.col("_set.turns"), F.lit(0))) % 2 == 1
    return rows.withColumns({"fixed": F.col("_set.to"), "turned": turned}).drop("_turns", "_set")


def _applied(fixed: Column, turned: Column, start: Column) -> Column:
    state = F.coalesce(fixed, start)
    return F.when(turned, ~state).otherwise(state)


def multi_line(lines: DataFrame) -> DataFrame:
    """``file, block, place, from_block, from_place``: the lines of records over several lines, and the line each begins with.

    Only places and steps are shuffled, by split and never by file; a file counts one row for each split.
    """
    steps = lines.select("file", "block", "place", "from_out", "from_in")
    w = Window.partitionBy("file", "block").orderBy("place")
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.col("from_out"))
    flips = F.when(F.col("from_out") & ~F.col("from_in"), 1).otherwise(0)
    steps = _composed(steps, w, fixed, flips)
    along = Window.partitionBy("file").orderBy("block")
    ends = steps.groupBy("file", "block").agg(F.max_by(F.struct("fixed", "turned"), "place").alias("s")).select("file", "block", "s.*")
    ends = _composed(ends, along, F.when(F.col("turned"), ~F.col("fixed")).otherwise(F.col("fixed")), F.when(F.col("fixed").isNull() & F.col("turned"), 1).otherwise(0))
    # at the start of a file: outside
    entry = ends.select(
        "file",
        "block",
        F.coalesce(F.lag(_applied(F.col("fixed"), F.col("turned"), F.lit(False))).over(along), F.lit(False)).alias("entry"),
    )
    states = steps.join(entry, ["file", "block"]).withColumn("after", _applied(F.col("fixed"), F.col("turned"), F.col("entry")))
    states = states.withColumn("before", F.coalesce(F.lag("after").over(w), F.col("entry")))
    start = F.when(~F.col("before"), F.col("place"))
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = states.withColumn("from_place", F.last(start, True).over(run)).filter("before or after")
    # a record that began in an earlier split: the last line there that begins one
    last = states.groupBy("file", "block").agg(F.max(start).alias("last"))
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    began = F.when(F.col("last").isNotNull(), F.struct(F.col("block").alias("b"), F.col("last").alias("p")))
    last = last.withColumn("s", F.last(began, True).over(earlier)).select("file", "block", F.col("s.b").alias("_b"), F.col("s.p").alias("_p"))
    return held.join(last, ["file", "block"]).select(
        "file",
        "block",
        "place",
        F.when(F.col("from_place").isNull(), F.col("_b")).otherwise(F.col("block")).alias("from_block"),
        F.coalesce("from_place", "_p").alias("from_place"),
    )


def records(lines: DataFrame, where: str) -> DataFrame:
    """``file, block, place, value``: every record with the place of its first line; blank lines between records are none."""
    spark = lines.sparkSession
    multi_line(lines).write.parquet(where)
    held = spark.read.parquet(where)
    whole = lines.join(held, ["file", "block", "place"], "left_anti").filter(~F.col("blank")).select("file", "block", "place", "value")
    parts = F.sort_array(F.collect_list(F.struct("block", "place", "value")))
    gathered = lines.join(held, ["file", "block", "place"]).groupBy("file", "from_block", "from_place").agg(parts.alias("parts"))
    joined = gathered.select("file", F.col("from_block").alias("block"), F.col("from_place").alias("place"), F.array_join("parts.value", "\n").alias("value"))
    return whole.unionByName(joined)


def with_headers(found: DataFrame) -> tuple[DataFrame, list[str]]:
    """Records without the header of their file, with it as column ``header``, and the distinct headers.

    One job for all files. Only the distinct headers reach the driver. In files whose header ends with a carriage return
    that is part of every line end, and line ends within quotes become line feeds; in others it is text.
    """
    first = found.groupBy("file").agg(F.min(F.struct("block", "place")).alias("at")).select("file", "at.*")
    names = found.join(first, ["file", "block", "place"]).select(
        "file",
        F.col("block").alias("_b"),
        F.col("place").alias("_p"),
        F.regexp_replace("value", "^\ufeff|\r$", "").alias("header"),
        F.col("value").endswith("\r").alias("_crlf"),
    )
    headers = sorted(r["header"] for r in names.select("header").distinct().collect())
    rest = found.join(names, "file").filter((F.col("block") != F.col("_b")) | (F.col("place") != F.col("_p")))
    own = F.regexp_replace(F.replace("value", F.lit("\r\n"), F.lit("\n")), "\r$", "")
    return rest.withColumn("value", F.when(F.col("_crlf"), own).otherwise(F.col("value"))).drop("_b", "_p", "_crlf"), headers


def parsed(found: DataFrame, headers: list[str], wanted: list[str], keep_corrupt: bool) -> DataFrame:
    """The columns ``wanted`` of all records by the names in their file's header; a header without one of them is an error."""
    cases = F
    for header in headers:
        names = next(csv.reader([header]))
        if missing := [name for name in wanted if name not in names]:
            file = found.filter(F.col("header") == header).select("file").first()["file"]
            raise ValueError(f"{file} has no column {', '.join(missing)}")
        fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(CORRUPT, T.StringType())])
        options = {"escape": _QUOTE, "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        row = F.from_csv("value", fields.simpleString()[len("struct<") : -1].replace(":", " "), options)
        mine = F.struct(*[row[f"c{names.index(name)}"].alias(name) for name in wanted], row[CORRUPT].alias(CORRUPT))
        cases = cases.when(F.col("header") == header, mine)
    got = found.select(cases.alias("_r"))
    return got.select(*[F.col(f"_r.`{name}`") for name in wanted], *([F.col(f"_r.{CORRUPT}")] if keep_corrupt else []))


def read_records(spark: SparkSession, path: str, wanted: list[str], keep_corrupt: bool = False) -> DataFrame | None:
    """Columns ``wanted`` of all CSV files under ``path``; None where no file has a line."""
    where = shared_dir(spark, "csv")
    found, headers = with_headers(records(write_lines(spark, path, f"{where}/lines"), f"{where}/held"))
    return parsed(found, headers, wanted, keep_corrupt) if headers else None
