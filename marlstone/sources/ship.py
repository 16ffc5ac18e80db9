"""Make this package importable in the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Send the sources to the executors, once for each application; in local mode they are there."""
    context = spark.sparkContext
    if context.master.split("[")[0] == "local" or context.applicationId in _sent:
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="spark-marlstone-")) / f"{root.name}_sources.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent).as_posix())
    context.addPyFile(str(path))
    _sent.add(context.applicationId)
