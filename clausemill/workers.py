"""The package for Python workers on other machines."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once per application.

    Workers then need neither the repository's folder nor a path to it. Operators with Python
    code call this before they hand it to Spark.
    """
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _sent or not root.is_dir():
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="clausemill-")), "clausemill.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
