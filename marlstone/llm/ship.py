"""Make this package importable in the executors' Python workers, and bound what goes to them at a time."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Bytes of an Arrow batch, where the session sets none: the JVM and the worker of each task hold a batch or two, and Spark's 10,000 rows of text are some 25 MB.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application; bound the session's Arrow batches."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="spark-marlstone-")) / "marlstone_workers.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"marlstone/{source.relative_to(root)}")
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
