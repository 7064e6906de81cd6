"""Pages by the order index, and the newest events kept up by micro-batches."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from beatwatch.operators import paging
from beatwatch.sinks import tables

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Thirty days of events, some at one instant, some without a time, compacted with their index."""
    root = tmp_path_factory.mktemp("events")
    rows = [(f"{i:06d}", ("crimes", "arrests")[i % 2], START + timedelta(minutes=i * 7, milliseconds=i % 3)) for i in range(6000)]
    rows += [(f"same{i:04d}", "crimes", START + timedelta(days=9, seconds=1)) for i in range(400)] + [(f"none{i}", "arrests", None) for i in range(30)]
    df = spark.createDataFrame(rows, "event_id string, source_dataset string, processed_at timestamp")
    tables.compact_events(df, f"{root}/table", partitions=12, index=f"{root}/order")
    far = datetime.min
    return spark.read.parquet(f"{root}/table"), spark.read.parquet(f"{root}/order"), [r[0] for r in sorted(rows, key=lambda r: (-((r[2] or far) - far).total_seconds(), r[0]))]


def test_index_counts_what_is_newer(stored):
    events, index, order = stored
    rows = index.orderBy("newer").collect()
    assert sum(r["n"] for r in rows) == len(order)
    assert [r["newer"] for r in rows] == [sum(x["n"] for x in rows[:i]) for i in range(len(rows))]
    assert rows[-1]["second"] is None and rows[-1]["n"] == 30


@pytest.mark.parametrize("skip,size", [(0, 50), (1234, 100), (6395, 60), (4000, 700), (6425, 50), (9999, 10)])
def test_pages_anywhere(stored, skip, size):
    events, index, order = stored
    assert [r["event_id"] for r in paging.indexed_page(events, index, skip, size).collect()] == order[skip : skip + size]


def test_a_hot_second_is_narrowed_further(stored, monkeypatch):
    monkeypatch.setattr(paging, "LEFT_ROWS", 100)
    events, index, order = stored
    skip = order.index("same0200")
    assert [r["event_id"] for r in paging.indexed_page(events, index, skip, 20).collect()] == order[skip : skip + 20]


def test_the_oldest_page_reads_few_rows(spark, stored):
    events, index, order = stored
    dated = events.filter(F.col("processed_at").isNotNull())
    left, skip, kept = paging.page_rows(dated, index.filter("second is not null"), 6350, 50)
    assert left.count() == kept <= 60 and skip < 10
    # the scan takes the files of that day alone
    files = {f for f in left.inputFiles()}
    scanned = spark.read.parquet(*{f for f in files if "event_date=2024-01-01" in f}).count() if any("2024-01-01" in f for f in files) else 0
    assert 0 < scanned < 0.05 * len(order)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_replay_slider(stored):
    events, index, order = stored
    for slider in (100, 37, 0):
        skip = paging.replay_offset(slider, len(order))
        assert [r["event_id"] for r in paging.replay_page(events, slider, index).collect()] == order[skip : skip + 50]
    assert paging.replay_page(events.limit(0), 50, paging.order_index(events.limit(0))).collect() == []


def test_the_newest_events_after_every_batch(spark, tmp_path):
    path, seen = str(tmp_path / "newest"), []
    at = lambda i: START + timedelta(seconds=i)
    batches = [[(f"a{i}", at(i)) for i in range(0, 40, 2)], [(f"b{i}", at(i)) for i in range(100, 112)], [(f"late{i}", at(i)) for i in (-5, 41, 105)] + [("none", None)], []]
    for number, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, "event_id string, processed_at timestamp")
        seen += rows
        for _ in range(2):  # each batch is repeated once
            tables.merge_newest(batch, path, number, n=15)
            want = [r[0] for r in sorted(seen, key=lambda r: (-(r[1].timestamp() if r[1] else float("-inf")), r[0]))[:15]]
            assert sorted(r["event_id"] for r in tables.read_newest(spark, path).collect()) == sorted(want)
    assert len(tables._children(spark, path, "batch_id")) == 2
