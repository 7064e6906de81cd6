"""Sending this package to the workers of a session that was started elsewhere."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers the package as a Python file of the session, unless they find it by path.

    Workers start in the driver's folder with its PYTHONPATH; a session that was submitted with the package
    as ``--py-files`` has it as well. The archive is made once for each application.
    """
    context = spark.sparkContext
    paths = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    if str(ROOT) in paths or not ROOT.is_dir() or context.applicationId in _SENT:
        return
    archive = Path(tempfile.mkdtemp(prefix="beatwatch-code-")) / "beatwatch.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((ROOT / "beatwatch").rglob("*.py")):
            out.write(file, file.relative_to(ROOT))
    context.addPyFile(str(archive))
    _SENT.add(context.applicationId)
