"""This package on the executors, wherever the driver was started from."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tallyforge-code-")  # the driver's own; Spark copies the archive
    copy = shutil.copytree(package, os.path.join(folder, "tree", os.path.basename(package)), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "tallyforge_code"), "zip", os.path.dirname(copy)))
    _shipped.add(app)
