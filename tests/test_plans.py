"""Physical plans: what must be there at scale, and what must not."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from beatwatch.operators import joins, paging, summaries, windows
from beatwatch.operators.enrich import valid_events
from beatwatch.plans.registry import Tables
from beatwatch.session import shared_dir

SF = "/root/testdata/sf0.001"
STREAMED = re.compile(r"^(str\d+|snk\d+|set2|src\d+|agg30|ml\d)$")
LAZY = sorted(n for n in entry.queries() if not STREAMED.match(n))


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert not re.search(r"PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas|CartesianProduct|BroadcastNestedLoopJoin", text)


@pytest.mark.parametrize("name", ["agg3", "agg6", "agg20", "pag1", "pag2", "top2", "top3d", "srt2"])
def test_top_k_is_not_a_sort(spark, name):
    assert "TakeOrderedAndProject" in plan(entry.queries()[name](spark, SF))


@pytest.fixture(scope="module")
def stored(spark):
    """Enriched events as a stored table, as the serving queries find them."""
    path = shared_dir(spark, "stored")
    Tables(spark, SF).gold.write.parquet(path)
    return spark.read.parquet(path)


def test_filters_and_columns_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(paging.event_history(stored.select("event_id", "source_dataset", "processed_at"), "crimes"))
    assert "EqualTo(source_dataset,crimes)" in text
    assert "ReadSchema: struct<event_id:string,source_dataset:string,processed_at:timestamp_ntz>" in text
    text = plan(valid_events(stored).select("event_id"))
    assert "Not(EqualTo(district,))" in text and "ReadSchema: struct<event_id:string,incident_date:string,district:string>" in text
    text = plan(summaries.district_summary(stored))
    assert "ReadSchema: struct<district:string,severity:int,processed_at:timestamp_ntz>" in text


def test_group_by_combines_before_the_shuffle(spark, stored):
    text = plan(summaries.district_summary(stored))
    assert text.count("HashAggregate") >= 2 and "partial_count" in text


def test_volume_windows_shuffle_panes_and_not_copies(spark, stored):
    timed = stored.withColumn("event_time", F.col("processed_at"))
    text = plan(windows.volume_windows(timed)).split("== Physical Plan ==")[1]
    expand, first = text.index("Expand"), text.rindex("partial_count")
    assert expand < first  # printed top down: rows are counted into panes before panes are expanded


def test_only_small_sides_are_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = Tables(spark, SF).crimes.select("case_number", "arrest")
        right = joins.one_per_key(Tables(spark, SF).arrests.select("case_number", "race"), "case_number", ["race"])
        text = plan(joins.left_join_one(left, right, "case_number")).split("== Physical Plan ==")[1]
        # the large sides meet in one sort-merge join on the key alone; nothing is salted
        assert re.search(r"SortMergeJoin \[case_number#\d+\], \[case_number#\d+\]", text)
        assert text.count("SortMergeJoin") == 1 and "_salt" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_small_state_partitions_are_restored(spark):
    from beatwatch.session import state_partitions

    before = spark.conf.get("spark.sql.shuffle.partitions")
    with state_partitions(spark, 3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
