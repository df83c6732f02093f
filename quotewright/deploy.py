"""Puts this package on the executors' path, for clusters that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources to the session's Python files, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="quotewright-src-"), "quotewright.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.join("quotewright", os.path.relpath(full, top)))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
