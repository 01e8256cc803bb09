"""Getting this package to the Python workers of a cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


#: Rows of an Arrow batch.  Texts are long: the default of 10 000 rows would hold tens of megabytes in each Python worker, several times over.
BATCH_ROWS = 1000
_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once per application, and make Arrow batches small unless they were set."""
    if spark.conf.get(_CONF) == "10000":
        spark.conf.set(_CONF, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="quaestor-src-"), "quaestor.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
