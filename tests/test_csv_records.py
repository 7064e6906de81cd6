"""Multi-line CSV read by many tasks, against the engine's own reader of one task a file."""

from __future__ import annotations

import random
import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from beatwatch.schemas import RAW_COLUMNS
from beatwatch.sources import csv_records
from beatwatch.sources.csv_files import find_csv, read_csv
from pyspark.sql import types as T

WANTED = ["A", "b c"]
SPLIT = "spark.sql.files.maxPartitionBytes"
OPEN = "spark.sql.files.openCostInBytes"


def random_csv(seed, rows, end="\n", columns=5):
    """Quoted line feeds, doubled quotes, stray quotes, blank lines, short and long rows."""
    draw = random.Random(seed)

    def field():
        kind = draw.random()
        if kind < 0.3:
            return draw.choice(["x", "1.5", "a b", " lead", "trail ", '5" pipe', "é", "it's", 'q"'])
        if kind < 0.45:
            return draw.choice(["", '""'])
        return '"' + "".join(draw.choice(["a", ",", "\n", '""', "\r\n", " ", "word ", '"",""', "\n\n"]) for _ in range(draw.randint(0, 12))) + '"'

    lines = [",".join(["id", "b c", "A", *[f"x{i}" for i in range(columns - 3)]])]
    for _ in range(rows):
        count = columns if draw.random() > 0.03 else draw.choice([1, columns - 1, columns + 2])
        lines.append(",".join(field() for _ in range(count)))
        if draw.random() < 0.03:
            lines.append("")
    return end.join(lines)


def one_task(spark, path):
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE")
    names = reader.csv(path).columns
    reader = reader.option("columnPruning", False).option("columnNameOfCorruptRecord", csv_records.CORRUPT)
    rows = reader.schema(", ".join(f"`{n}` string" for n in names) + f", {csv_records.CORRUPT} string").csv(path)
    return rows.select(*WANTED, csv_records.CORRUPT).collect()


def counted(rows):
    """The text of a malformed record keeps its line ends in one reader and not in the other."""
    return Counter((r[0], r[1], r[2] and r[2].replace("\r\n", "\n")) for r in rows)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("many csv")
    (root / "one file.csv").write_text(random_csv(1, 400) + "\n", newline="")
    (root / "crlf 100%.csv").write_text(random_csv(2, 300, "\r\n", 6) + "\r\n", newline="")
    (root / "no end.csv").write_text(random_csv(3, 60, columns=3), newline="")
    (root / "bom.csv").write_text("A,b c\n1,2\n", encoding="utf-8-sig")
    (root / "only a header.csv").write_text("b c,A\n")
    (root / "empty.csv").write_text("")
    (root / "long field.csv").write_text('A,b c\n1,"' + "line\n" * 400 + '"\n3,4\n')
    return root


@pytest.mark.parametrize("size", ["128m", "97b"])
def test_as_the_reader_of_one_task(spark, folder, tmp_path, size):
    want: Counter = Counter()
    for number, file in enumerate(sorted(folder.iterdir())):
        if file.stat().st_size:
            shutil.copy(file, tmp_path / f"{number}.csv")
            want.update(counted(one_task(spark, str(tmp_path / f"{number}.csv"))))
    before = {k: spark.conf.get(k) for k in (SPLIT, OPEN)}
    spark.conf.set(SPLIT, size)
    spark.conf.set(OPEN, "0")
    try:
        csv_records.write_lines(spark, f"{folder}/*.csv", str(tmp_path / "lines"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    lines = spark.read.parquet(str(tmp_path / "lines"))
    blocks = lines.select("file", "block").distinct().count()
    assert blocks > 100 or size == "128m"
    found, headers = csv_records.with_headers(csv_records.records(lines, str(tmp_path / "held")))
    assert len(headers) == 5
    assert counted(csv_records.parsed(found, headers, WANTED, True).collect()) == want


def test_only_records_over_several_lines_are_gathered(spark, folder, tmp_path):
    lines = csv_records.write_lines(spark, f"{folder}/long field.csv", str(tmp_path / "lines"))
    held = csv_records.multi_line(lines)
    assert held.count() == 401 and held.select("from_block", "from_place").distinct().count() == 1
    plain = csv_records.write_lines(spark, f"{folder}/bom.csv", str(tmp_path / "plain"))
    assert csv_records.multi_line(plain).count() == 0


def test_header_over_several_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n"q\nq",A,b c\n1,"2\n",3\n')
    schema = T.StructType([T.StructField(n, T.StringType()) for n in WANTED])
    assert [tuple(r) for r in read_csv(spark, f"{tmp_path}/a.csv", schema).collect()] == [("2\n", "3")]


def test_headers_of_many_files_by_one_set_of_jobs(spark, tmp_path):
    names = list(RAW_COLUMNS["police-stations"])
    for i in range(120):
        order = names if i % 3 else names[::-1]
        (tmp_path / f"Police Stations {i} 50%25 #a.csv").write_text(",".join(order) + "\n" + ",".join(f"{n} {i}" for n in order) + "\n")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        found = find_csv(spark, str(tmp_path), "tations", "police-stations")
        jobs = len(tracker.getJobIdsForGroup("headers"))
        rows = found.collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 40
    assert sorted(r["DISTRICT"] for r in rows) == sorted(f"DISTRICT {i}" for i in range(120))
    assert all(r[n].split()[-1] == r["DISTRICT"].split()[-1] for r in rows for n in names)


def test_names_as_published(spark, tmp_path):
    names = list(RAW_COLUMNS["sex-offenders"])
    for i, name in enumerate(("Sex Offenders.csv", "SEX_OFFENDERS-2.csv", "other.csv")):
        (tmp_path / name).write_text(",".join(names) + "\n" + ",".join([str(i)] * len(names)) + "\n")
    from beatwatch.plans.batch_job import FILE_KEYWORDS

    rows = find_csv(spark, str(tmp_path), FILE_KEYWORDS["sex-offenders"], "sex-offenders")
    assert sorted(r["LAST"] for r in rows.select(F.col("LAST")).collect()) == ["0", "1"]
    with pytest.raises(FileNotFoundError):
        find_csv(spark, str(tmp_path), "rimes", "crimes")
