"""What a session needs to run the library."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
_own: dict[str, tuple[str, str]] = {}

#: Bytes that come to Python at once, about; a row that is larger comes alone.
_MOST_BYTES = 4 << 20


def batches(spark: SparkSession, rows: int | None) -> None:
    """How many rows come to Python at once, and of large rows fewer, so that a worker's memory doesn't grow with the rows of its task or with their size; None: what the session had."""
    own, own_bytes = _own.setdefault(spark.sparkContext.applicationId, (spark.conf.get(_BATCH), spark.conf.get(_BYTES)))
    spark.conf.set(_BATCH, own if rows is None else str(min(rows, int(own)) if int(own) > 0 else rows))
    spark.conf.set(_BYTES, own_bytes if rows is None else str(_MOST_BYTES))


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, so that their Python finds it wherever they started; once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, f"{top.name}/{file.relative_to(top)}")
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
