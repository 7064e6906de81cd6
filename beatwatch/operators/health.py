"""Stream-health detectors: silence, low rate, a dataset gone quiet; over the event table, and over the stream itself."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


def windowed_rates(events: DataFrame, minutes: int, ts: str = "processed_at", key: str | None = None, as_of: datetime | Column | None = None) -> DataFrame:
    """Count and rate of every whole window (per key seen), 0 where nothing arrived.

    Windows run from the first event to ``as_of`` (default: the last event); those that these two cut
    are left out, as they could only look low. A feed that has stopped shows up when ``as_of`` is the
    present. The events are counted once; span and keys come from the counts. The grid is laid out by day
    and then by window, so it grows by rows and is never one array.
    """
    length = minutes * 60
    second = F.unix_timestamp(F.col(ts).cast("timestamp"))
    keys = [key] if key else []
    counts = events.filter(F.col(ts).isNotNull()).groupBy(F.floor(second / length).cast("long").alias("_w"), *keys)
    counts = counts.agg(F.count("*").alias("n"), F.min(second).alias("_first"), F.max(second).alias("_last"))
    end = F.max("_last") if as_of is None else F.unix_timestamp(as_of if isinstance(as_of, Column) else F.lit(as_of))
    # the first window that begins at or after the first event, and the last that ends by the end
    span = counts.agg(
        F.struct(F.ceil(F.min("_first") / length).cast("long").alias("lo"), (F.floor(end / length) - 1).cast("long").alias("hi")).alias("s")
    ).scalar()
    owners = counts.select(*keys).distinct() if key else counts.agg(F.count("*").alias("_n")).filter("_n > 0").select()
    per_day = DAY // length if DAY % length == 0 else 1
    days = owners.withColumn("_s", span).filter("_s.lo <= _s.hi")
    days = days.withColumn("_d", F.explode(F.sequence(F.floor(F.col("_s.lo") / per_day), F.floor(F.col("_s.hi") / per_day))))
    grid = days.repartition("_d").withColumn("_w", F.explode(F.sequence(F.col("_d") * per_day, F.col("_d") * per_day + per_day - 1)))
    grid = grid.filter(F.col("_w").between(F.col("_s.lo"), F.col("_s.hi"))).select("_w", *keys)
    seen = counts.select("_w", *[F.col(k).alias("_k") for k in keys], "n")
    same = F.col("g._w") == F.col("s._w")
    if key:
        same = same & F.col(f"g.{key}").eqNullSafe(F.col("s._k"))
    joined = grid.alias("g").join(seen.alias("s"), same, "left")
    count = F.coalesce(F.col("s.n"), F.lit(0).cast("long"))
    return joined.select(
        F.timestamp_seconds(F.col("g._w") * length).alias("window_start"),
        *[F.col(f"g.{k}").alias(k) for k in keys],
        count.alias("event_count"),
        (count / length).alias("events_per_second"),
    )


def held(failing: DataFrame, minutes: int, hold: int, key: str | None = None) -> DataFrame:
    """Failing windows whose condition has held for ``hold`` minutes at their end.

    Each failing window counts for itself and the ones after it; a window that all of its
    predecessors count for has held.
    """
    need = max(1, -(-hold // minutes))
    if need == 1:
        return failing
    keys = [key] if key else []
    length = minutes * 60
    votes = failing.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(need - 1))))
    at = F.timestamp_seconds(F.unix_timestamp("window_start") + F.col("_j") * length)
    own = [F.max(F.when(F.col("_j") == 0, F.col(c))).alias(c) for c in ("event_count", "events_per_second")]
    voted = votes.withColumn("window_start", at).groupBy("window_start", *keys).agg(F.count("*").alias("_votes"), *own)
    return voted.filter(F.col("_votes") == need).select(*failing.columns)


def no_events(events: DataFrame, ts: str = "processed_at", minutes: int = 2, as_of: datetime | Column | None = None, hold: int = 0) -> DataFrame:
    return held(windowed_rates(events, minutes, ts, as_of=as_of).filter(F.col("event_count") == 0), minutes, hold)


def low_rate(
    events: DataFrame, ts: str = "processed_at", minutes: int = 5, below: float = 0.5, as_of: datetime | Column | None = None, hold: int = 0
) -> DataFrame:
    return held(windowed_rates(events, minutes, ts, as_of=as_of).filter(F.col("events_per_second") < below), minutes, hold)


def silent_datasets(
    events: DataFrame, ts: str = "processed_at", minutes: int = 5, key: str = "source_dataset", as_of: datetime | Column | None = None, hold: int = 0
) -> DataFrame:
    return held(windowed_rates(events, minutes, ts, key, as_of).filter(F.col("event_count") == 0), minutes, hold, key)


def heartbeats(clock: DataFrame, expected: Sequence[str | None], at: str = "timestamp", key: str = "source_dataset") -> DataFrame:
    """A row for every tick of a clock and every expected key: a rate stream, or any table of times, batch or stream."""
    keys = F.array(*[F.lit(k).cast("string") for k in expected])
    return clock.select(F.col(at).cast("timestamp").alias("_at"), F.explode(keys).alias(key))


def live_rates(
    events: DataFrame, beats: DataFrame, minutes: int, ts: str = "processed_at", key: str = "source_dataset", watermark: str = "1 minute"
) -> DataFrame:
    """Count and rate of every window and key that had an event or a heartbeat, for streams in append mode.

    Heartbeats weigh nothing but stand in their windows and push the watermark on, so a feed that stops has
    windows with count 0 as long as the clock runs. A window comes once, when the watermark has passed its end.
    """
    rows = events.select(F.col(ts).cast("timestamp").alias("_at"), key, F.lit(1).alias("_weight"))
    both = rows.unionByName(beats.select("_at", key, F.lit(0).alias("_weight")))
    if both.isStreaming:
        both = both.withWatermark("_at", watermark)
    counts = both.groupBy(F.window("_at", f"{minutes} minutes").alias("w"), key).agg(F.sum("_weight").alias("event_count"))
    return counts.select(F.col("w.start").alias("window_start"), key, "event_count", (F.col("event_count") / (minutes * 60)).alias("events_per_second"))


def live_silence(rates: DataFrame, below: float | None = None) -> DataFrame:
    """Windows without an event, or with a rate under ``below``."""
    return rates.filter(F.col("event_count") == 0 if below is None else F.col("events_per_second") < below)
