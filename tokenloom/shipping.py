"""Python workers need this package: a cluster's executors may not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the session's Python workers, once an application. Spark serves the file
    from the driver; no shared folder takes part."""
    context, folder = spark.sparkContext, os.path.dirname(os.path.abspath(__file__))
    if context.applicationId in _shipped or not os.path.isdir(folder):
        return
    name = os.path.basename(folder)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}-{context.applicationId}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for directory, _, files in os.walk(folder):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(directory, f)
                    out.write(full, os.path.join(name, os.path.relpath(full, folder)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
