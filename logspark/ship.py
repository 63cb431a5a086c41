"""Send this package to Python workers, so that they can import it wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_MARK = "_logspark_shipped"


def ship(spark: SparkSession) -> None:
    """Once per Spark context: a small archive that Spark hands to every executor. No harm where the package is installed."""
    context = spark.sparkContext
    if getattr(context, _MARK, False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="logspark-ship-"), "logspark-package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("logspark", os.path.relpath(full, root)))
    context.addPyFile(path)
    setattr(context, _MARK, True)
