"""Sends this package to the executors, whose Python may not find it."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application, through Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(package)
    if os.path.isdir(package):
        # served from there as long as the application runs
        folder = tempfile.mkdtemp()
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, f"quire-{uuid.uuid4().hex}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for place, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(place, name)
                        z.write(full, os.path.relpath(full, top))
        sc.addPyFile(path)
    _shipped.add(sc.applicationId)
