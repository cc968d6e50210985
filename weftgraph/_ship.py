"""Makes the package importable for Python workers, wherever they start."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch where the session leaves Spark's defaults: rows here are whole documents, and what a
#: batch takes is held by the executor and by its worker.
BATCH = {"maxRecordsPerBatch": ("10000", "2000"), "maxBytesPerBatch": ("67108864b", "8388608b")}


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers of this application, once."""
    context = spark.sparkContext
    for name, (default, own) in BATCH.items():
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", own)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).parent
    at = Path(tempfile.mkdtemp()) / "weftgraph_src.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(at))
    _shipped.add(context.applicationId)
