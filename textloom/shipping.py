"""Brings this package to the executors, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

_shipped: set[str] = set()
_lock = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Adds the package's sources to the session's files once, so that workers can import it from any folder."""
    context = spark.sparkContext
    with _lock:
        if context.applicationId not in _shipped:
            _add(context)
            _shipped.add(context.applicationId)


def _add(context: SparkContext) -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(), "textloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
