"""Newest-first pages over the event and alert tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beatwatch.operators.summaries import clamp

# deep_page stops counting when no more than this many rows are left for its top-k
LEFT_ROWS = 10_000


def event_history(
    events: DataFrame,
    dataset: str | None = None,
    limit: int | None = None,
    offset: int = 0,
    ts: str = "processed_at",
    key: str = "event_id",
    max_limit: int = 500,
    default_limit: int = 50,
) -> DataFrame:
    """One page of events, newest first, ties by key: a lazy top-k, which runs no job of its own.

    Its cost grows with ``offset``; ``deep_page`` is the form for pages far from the newest end.
    """
    rows = events.filter(F.col("source_dataset") == dataset) if dataset else events
    size, skip = clamp(limit, max_limit, default_limit), max(offset, 0)
    return rows.orderBy(F.desc(ts), F.asc(key)).offset(skip).limit(size)


def recent_alerts(
    alerts: DataFrame, dataset: str | None = None, limit: int | None = None, ts: str = "processed_at", key: str = "event_id"
) -> DataFrame:
    return event_history(alerts, dataset, limit, 0, ts, key, max_limit=200, default_limit=20)


def replay_offset(slider: int, total: int, page: int = 50) -> int:
    """Offset of a replay slider, 100 = newest, 0 = oldest; halves round up."""
    return math.floor((100 - slider) / 100 * max(total - page, 0) + 0.5)


def replay_page(events: DataFrame, slider: int, index: DataFrame, page: int = 50, ts: str = "processed_at", key: str = "event_id") -> DataFrame:
    """The page at a replay slider, by the order index: as cheap at the oldest end as at the newest."""
    total = index.agg(F.max(F.col("newer") + F.col("n")).alias("t")).first()["t"] or 0
    return indexed_page(events, index, replay_offset(slider, total, page), page, ts, key)


def order_index(events: DataFrame, ts: str = "processed_at") -> DataFrame:
    """``event_date, second, n, newer``: the events of each second, and how many events are newer than it.

    Seconds are counted first; the sums run over the seconds of a day, and over days. Events without a time are the
    oldest, a second and a day of their own.
    """
    seconds = events.groupBy(F.date_trunc("second", ts).alias("second")).agg(F.count("*").alias("n")).withColumn("event_date", F.to_date("second"))
    days = seconds.groupBy("event_date").agg(F.sum("n").alias("_day"))
    # one row a day
    days = days.withColumn("_newer", F.sum("_day").over(Window.orderBy(F.col("event_date").desc_nulls_last())) - F.col("_day"))
    days = days.select(F.col("event_date").alias("_d"), "_newer")
    within = Window.partitionBy("event_date").orderBy(F.col("second").desc_nulls_last())
    placed = seconds.withColumn("_upto", F.sum("n").over(within)).join(days, F.col("event_date").eqNullSafe(F.col("_d")))
    return placed.select("event_date", "second", "n", (F.col("_newer") + F.col("_upto") - F.col("n")).alias("newer"))


def write_order_index(events: DataFrame, path: str, ts: str = "processed_at") -> DataFrame:
    """The index as a table beside the events, sorted by place, so that a page reads few of its row groups."""
    index = order_index(events, ts)
    index.repartitionByRange("newer").sortWithinPartitions("newer").write.mode("overwrite").parquet(path)
    return events.sparkSession.read.parquet(path)


def page_rows(events: DataFrame, index: DataFrame, skip: int, size: int, ts: str = "processed_at") -> tuple[DataFrame, int, int]:
    """The events of the seconds that a page touches, how many of them come before it, and how many they are.

    One small job on the index; the events are then filtered by a plain range of time, and by ``event_date`` where they are
    stored by it, so their scan skips all other files and row groups.
    """
    hit = index.filter((F.col("newer") < skip + size) & (F.col("newer") + F.col("n") > skip))
    span = hit.agg(F.min("second").alias("lo"), F.max("second").alias("hi"), F.min("newer").alias("newer"), F.sum("n").alias("n"), F.count_if(F.col("second").isNull()).alias("nulls")).first()
    if span["n"] is None:
        return events.limit(0), 0, 0
    kind = events.schema[ts].dataType
    inside = F.lit(False)
    if span["lo"] is not None:
        low, high = (F.lit(span[c]).cast(kind) for c in ("lo", "hi"))
        inside = (F.col(ts) >= low) & (F.col(ts) < high + F.expr("interval 1 second"))
        if "event_date" in events.columns:
            inside = inside & F.col("event_date").between(F.to_date(low), F.to_date(high))
    if span["nulls"]:
        inside = inside | F.col(ts).isNull()
    return events.filter(inside), skip - span["newer"], span["n"]


def indexed_page(events: DataFrame, index: DataFrame, skip: int, size: int, ts: str = "processed_at", key: str = "event_id") -> DataFrame:
    """A page anywhere in the order by way of the index: newest first, ties by key.

    Where the seconds of the page hold more than ``LEFT_ROWS`` events, they are narrowed further as ``deep_page`` does.
    """
    left, inner, kept = page_rows(events, index, skip, size, ts)
    if kept > LEFT_ROWS:
        return deep_page(left, inner, size, ts, key)
    return left.orderBy(F.col(ts).desc_nulls_last(), F.asc(key)).offset(inner).limit(size)


# Time buckets from coarse to fine, as sortable text, with their length.
_TIME_STEPS = (
    ("yyyy-MM-dd 00:00:00", "interval 1 day"),
    ("yyyy-MM-dd HH:00:00", "interval 1 hour"),
    ("yyyy-MM-dd HH:mm:ss", "interval 1 second"),
    ("yyyy-MM-dd HH:mm:ss.SSSSSS", "interval 1 microsecond"),
)


def _narrow_time(rows: DataFrame, ts: str, step: tuple[str, str], skip: int, size: int) -> tuple[DataFrame, int, int]:
    """Keep the time buckets the page lies in; return (rows, rows to skip in them, rows kept).

    One grouped count; the running total runs over bucket counts, not over rows. The kept span is
    a plain range on the time column, so the next scan can skip row groups.
    """
    form, length = step
    counts = rows.groupBy(F.date_format(ts, form).alias("_b")).agg(F.count("*").alias("_n"))
    through = counts.withColumn("_through", F.sum("_n").over(Window.orderBy(F.col("_b").desc_nulls_last())))
    hit = through.filter((F.col("_through") > skip) & (F.col("_through") - F.col("_n") < skip + size))
    span = hit.agg(
        F.min("_b").alias("lo"),
        F.max("_b").alias("hi"),
        F.min(F.col("_through") - F.col("_n")).alias("before"),
        F.sum("_n").alias("kept"),
        F.count_if(F.col("_b").isNull()).alias("nulls"),
    ).first()
    if span["kept"] is None:
        return rows.limit(0), 0, 0
    kind = rows.schema[ts].dataType
    inside = F.col(ts).isNull() if span["nulls"] else F.lit(False)
    if span["lo"] is not None:
        low, high = F.lit(span["lo"]).cast(kind), F.lit(span["hi"]).cast(kind) + F.expr(length)
        between = (F.col(ts) >= low) & (F.col(ts) < high)
        inside = between | F.col(ts).isNull() if span["nulls"] else between
    return rows.filter(inside), skip - span["before"], span["kept"]


def deep_page(rows: DataFrame, skip: int, size: int, ts: str = "processed_at", key: str = "event_id") -> DataFrame:
    """A page far from the newest end: count by day, hour, second, instant, then by key range.

    Runs a job for each step while the page is built. Each step reads the rows of the step before and keeps only the buckets the page touches, so
    few rows are left for the final top-k even when one instant holds a large share.
    """
    left, inner, kept = rows, skip, None
    for step in _TIME_STEPS:
        left, inner, kept = _narrow_time(left, ts, step, inner, size)
        if kept <= LEFT_ROWS:
            break
    if kept > LEFT_ROWS and dict(rows.dtypes)[key] == "string":
        for width in (2, 4, 8, 16, 32, 64):
            left, inner, kept = _narrow_ties(left, ts, F.substring(key, 1, width), inner, size)
            if kept <= LEFT_ROWS:
                break
    elif kept > LEFT_ROWS:
        points = [i / 1000 for i in range(1, 1000)]
        edges = left.agg(F.percentile_approx(key, points, 100_000).alias("e")).first()["e"]
        bounds = F.array(*[F.lit(e) for e in sorted(set(edges))])
        bucket = F.size(F.filter(bounds, lambda e: e < F.col(key)))
        left, inner, kept = _narrow_ties(left, ts, bucket, inner, size)
    return left.orderBy(F.desc(ts), F.asc(key)).offset(inner).limit(size)


def _narrow_ties(rows: DataFrame, ts: str, bucket: Column, skip: int, size: int) -> tuple[DataFrame, int, int]:
    """As ``_narrow`` for rows ordered by (time descending, key bucket ascending)."""
    counts = rows.groupBy(F.col(ts).alias("_t"), bucket.alias("_b")).agg(F.count("*").alias("_n"))
    order = Window.orderBy(F.col("_t").desc_nulls_last(), F.col("_b").asc_nulls_first())
    through = counts.withColumn("_through", F.sum("_n").over(order))
    hit = through.filter((F.col("_through") > skip) & (F.col("_through") - F.col("_n") < skip + size))
    before = hit.agg(F.min(F.col("_through") - F.col("_n")).alias("b"), F.sum("_n").alias("k")).first()
    if before["k"] is None:
        return rows.limit(0), 0, 0
    keys = hit.select(F.col("_t").alias("_ht"), F.col("_b").alias("_hb"))
    # at most ``size`` buckets touch a page
    same = F.col(ts).eqNullSafe(F.col("_ht")) & bucket.eqNullSafe(F.col("_hb"))
    return rows.join(F.broadcast(keys), same, "left_semi"), skip - before["b"], before["k"]
