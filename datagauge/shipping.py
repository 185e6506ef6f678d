"""Send this package to Python workers that don't have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the Spark job once per context; Spark copies them to executors."""
    context = spark.sparkContext
    if getattr(context, "_datagauge_shipped", False):
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="datagauge-")) / "datagauge.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, os.path.join(top.name, source.relative_to(top)))
    context.addPyFile(str(path))
    context._datagauge_shipped = True
