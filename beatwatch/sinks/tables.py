"""Table sinks: whole-table overwrite, repeatable micro-batch append, documents, upsert view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beatwatch.operators.paging import write_order_index
from beatwatch.operators.summaries import rolling_buffer
from beatwatch.schemas import conform


def overwrite_table(df: DataFrame, root: str, name: str, jdbc: dict[str, str] | None = None) -> None:
    """Replace a result table, as Parquet under ``root`` or through JDBC with the given options."""
    checked = conform(df, name)
    if jdbc:
        checked.write.format("jdbc").options(**jdbc, dbtable=name, truncate="true").mode("overwrite").save()
    else:
        checked.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}")


def write_batch(df: DataFrame, path: str, batch_id: int, form: str = "parquet") -> None:
    """Write one micro-batch to its own partition. A repeated batch replaces itself."""
    df.write.mode("overwrite").format(form).save(f"{path.rstrip('/')}/batch_id={batch_id}")


def write_documents(df: DataFrame, path: str, batch_id: int) -> None:
    """One JSON document per row, written by the executors."""
    write_batch(df, path, batch_id, "json")


def read_batches(spark: SparkSession, path: str, schema=None, form: str = "parquet") -> DataFrame:
    reader = spark.read.format(form)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def compact_events(events: DataFrame, path: str, partitions: int | None = None, ts: str = "processed_at", index: str | None = None) -> None:
    """Rewrite the many small micro-batch files for serving, by dataset and day, newest first.

    Rows are spread by ranges of (dataset, time), so a dataset or day that holds a large share
    is cut into several tasks; filters on dataset, day and time then skip files and row groups. With ``index`` the
    order index of the new table is written there, for pages of any depth.
    """
    by = ["source_dataset", "event_date", F.desc(ts)]
    dated = events.withColumn("event_date", F.to_date(ts))
    spread = dated.repartitionByRange(partitions, *by) if partitions else dated.repartitionByRange(*by)
    spread.sortWithinPartitions(*by).write.mode("overwrite").partitionBy("source_dataset", "event_date").parquet(path)
    if index:
        write_order_index(events.sparkSession.read.parquet(path), index, ts)


def newest_per_key(df: DataFrame, keys: list[str], version: str = "batch_id") -> DataFrame:
    """The last version of every key: what an update-mode stream has to say in the end.

    An aggregate with map-side combine; nulls in keys form their own group.
    """
    rest = [c for c in df.columns if c not in (*keys, version)]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def _children(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """Folders ``<prefix>=<number>`` right under ``path``, by number."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return {}
    names = [str(s.getPath().getName()) for s in store.listStatus(folder)]
    found = (n.partition("=") for n in names if n.startswith(f"{prefix}="))
    return {int(number): f"{path}/{prefix}={number}" for _, _, number in found}


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _whole(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def earlier_versions(spark: SparkSession, path: str, keys: list[str], batch_id: int) -> DataFrame | None:
    """``read_versions`` as it was before the batch ``batch_id``, also where that batch is written already; None if there was none."""
    batches, bases = (_children(spark, p, prefix) for p, prefix in ((path.rstrip("/"), "batch_id"), (f"{path.rstrip('/')}/_base", "upto")))
    if not any(n < batch_id for n in batches) and not any(n < batch_id and _whole(spark, p) for n, p in bases.items()):
        return None
    return read_versions(spark, path, keys, batch_id)


def merge_newest(batch: DataFrame, path: str, batch_id: int, n: int = 150, ts: str = "processed_at", key: str = "event_id") -> None:
    """Keep the ``n`` newest rows of a stream: those of the last state and of this batch, as the state of this batch.

    The order is by time, not by arrival, so late rows fall into their place or out. The state before is kept for a
    repeated batch, older ones are dropped.
    """
    spark, path = batch.sparkSession, path.rstrip("/")
    states = {i: p for i, p in _children(spark, path, "batch_id").items() if i < batch_id and _whole(spark, p)}
    rows = batch
    if states:
        rows = rows.unionByName(spark.read.parquet(states[max(states)]))
    write_batch(rolling_buffer(rows, n, ts, key).coalesce(1), path, batch_id)
    for i, old in states.items():
        if i < max(states):
            _drop(spark, old)


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The rows that ``merge_newest`` holds now."""
    states = _children(spark, path.rstrip("/"), "batch_id")
    return spark.read.parquet(states[max(i for i, p in states.items() if _whole(spark, p))])


def read_versions(spark: SparkSession, path: str, keys: list[str], before: int | None = None) -> DataFrame:
    """The newest version of every key: the last compaction and the batches after it, up to but not with batch ``before``.

    ``path`` must hold a batch or a compaction.
    """
    path = path.rstrip("/")
    wanted = lambda n: before is None or n < before
    bases = {n: p for n, p in _children(spark, f"{path}/_base", "upto").items() if wanted(n) and _whole(spark, p)}
    upto = max(bases, default=-1)
    parts = [spark.read.parquet(bases[upto]).withColumn("batch_id", F.lit(upto).cast("long"))] if bases else []
    later = [p for n, p in sorted(_children(spark, path, "batch_id").items()) if n > upto and wanted(n)]
    if later:
        parts.append(spark.read.option("basePath", path).parquet(*later).withColumn("batch_id", F.col("batch_id").cast("long")))
    return newest_per_key(reduce(DataFrame.unionByName, parts), keys)


def compact_versions(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Fold all batches but the last into one version per key, then drop what was folded.

    The last batch stays as it is, so a stream that repeats it after a failure replaces it. What was
    folded goes only after the new table is complete; a run that broke off in between leaves folders
    that ``read_versions`` passes over and the next run drops. Readers that began before may have to start again.
    """
    path = path.rstrip("/")
    batches = _children(spark, path, "batch_id")
    upto = max(batches, default=0) - 1
    bases = _children(spark, f"{path}/_base", "upto")
    if any(n <= upto for n in batches) and not (upto in bases and _whole(spark, bases[upto])):
        old = max((n for n, p in bases.items() if _whole(spark, p)), default=-1)
        fold = [p for n, p in sorted(batches.items()) if old < n <= upto]
        parts = [spark.read.option("basePath", path).parquet(*fold).withColumn("batch_id", F.col("batch_id").cast("long"))] if fold else []
        if old >= 0:
            parts.append(spark.read.parquet(bases[old]).withColumn("batch_id", F.lit(old).cast("long")))
        newest_per_key(reduce(DataFrame.unionByName, parts), keys).write.mode("overwrite").parquet(f"{path}/_base/upto={upto}")
    whole = {n for n, p in _children(spark, f"{path}/_base", "upto").items() if _whole(spark, p)}
    newest = max(whole, default=-1)
    for n, p in [*batches.items(), *((n + 1, p) for n, p in bases.items() if n != newest)]:
        if n <= newest:
            _drop(spark, p)
