"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings every job relies on. All can be set on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # HotSpot interprets methods above 8000 bytes of bytecode, so wider stages run faster unfused:
    # nrm5 at sf0.1 takes 10.1 s with this limit and 21.6 s with the engine's 65535, warm, on 8 cores
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# folders named within each open ``scratch``
_OPEN: list[list[str]] = []


def build_session(app_name: str = "beatwatch", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings the operators expect.

    On a cluster ``master`` and the sizing come from spark-submit. Shuffle partitions are
    left to AQE: give a generous ``spark.sql.shuffle.partitions`` and let it coalesce.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for tables and checkpoints that every executor can reach.

    The cluster names its shared folder in ``spark.checkpoint.dir``. Only a local session
    that names none may use a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="beatwatch-")
    path = f"{root.rstrip('/')}/beatwatch/{label}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop at the end what ``shared_dir`` names meanwhile; for a step whose result is written when it ends.

    A step that fails leaves its folders, as what reads them may run again.
    """
    mine: list[str] = []
    _OPEN.append(mine)
    try:
        yield
        for path in mine:
            drop_folder(spark, path)
    finally:
        _OPEN.pop()


@contextmanager
def state_partitions(spark: SparkSession, n: int | None = None) -> Iterator[None]:
    """Start streams with ``n`` state partitions (default: one per core of the cluster).

    A stream pins its partition count at its first start and AQE does not change it, so it is
    chosen for the cluster and not left at the batch setting.
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
