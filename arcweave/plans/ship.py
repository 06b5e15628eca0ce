"""Sends this package to the Python workers, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: the package's modules as one zip through Spark's file server."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    _SENT.add(sc.applicationId)
    package = Path(__file__).resolve().parent.parent
    at = os.path.join(tempfile.mkdtemp(prefix="arcweave-code-"), "arcweave_code.zip")
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"arcweave/{p.relative_to(package)}")
    sc.addPyFile(at)
