"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send a zip of the package to the executors, once an application, unless workers find it on their path."""
    package = Path(__file__).resolve().parent
    seen = {os.path.realpath(p) for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p}
    app = spark.sparkContext.applicationId
    if str(package.parent) not in seen and app not in _shipped:
        name = os.path.join(tempfile.mkdtemp(prefix="package-"), package.name)
        spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", package.parent, package.name))
        _shipped.add(app)
    return spark
